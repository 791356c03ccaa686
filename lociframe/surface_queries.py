"""Registered queries of record matching and merging, annotation, and of the SQL surface, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.cohort_queries import GT2
from lociframe.cohort_queries import second as other_genotypes
from lociframe.functions import expression as X
from lociframe.functions import formatting
from lociframe.operators import aggregates as A
from lociframe.operators import cohort as C
from lociframe.operators import joins as J
from lociframe.operators import transforms as T
from lociframe.operators import trios
from lociframe.operators import windows as W
from lociframe.plans.derive import genotypes, intervals, nested, rich, rich_tidy, sites, table
from lociframe.queries import FILL, OVER, OWN, TRIO_SQL, TRIOS, G, S, listed, query
from lociframe.rich_queries import CALLS, RG, SECOND, R

# another call set: every fourth site has another ALT, and every third is absent
ALT_B = "CASE WHEN site_id % 4 = 0 THEN concat(ALT, 'G') WHEN site_id % 7 = 3 AND length(ALT) = 1 THEN translate(ALT, 'ACGT', 'CGTA') ELSE ALT END"
B = f"(SELECT site_id, CHROM, POS, REF, {ALT_B} AS ALT, CASE WHEN site_id % 2 = 0 THEN concat('rs', site_id) END AS ID FROM {S} WHERE site_id % 3 <> 0) b"
TYPE = "CASE WHEN length({0}.ALT) <> length({0}.REF) THEN 'indels' WHEN length({0}.ALT) = 1 THEN 'snps' ELSE 'others' END"


def second(spark, d):
    s = sites(spark, d).where("site_id % 3 <> 0")
    return s.withColumn("ALT", F.split(F.expr(ALT_B), ",")).withColumn("ID", F.when(F.col("site_id") % 2 == 0, F.concat(F.lit("rs"), "site_id")))


SAME = "s.REF = b.REF AND s.ALT = b.ALT"
MODES = {
    "none": SAME, "all": "true", "some": SAME, "snps": f"({SAME} OR {TYPE.format('s')} = 'snps' AND {TYPE.format('b')} = 'snps')", "indels": f"({SAME} OR {TYPE.format('s')} = 'indels' AND {TYPE.format('b')} = 'indels')",
    "both": f"({SAME} OR {TYPE.format('s')} = {TYPE.format('b')} AND {TYPE.format('s')} <> 'others')",
}
for _mode, _on in MODES.items():

    def _compatible(spark, d, mode=_mode):
        return J.compatible(listed(sites(spark, d)), second(spark, d), mode).select("site_id")

    _compatible.__name__ = f"isec_compat_{_mode}"
    query(f"SELECT site_id FROM {S} WHERE EXISTS (SELECT 1 FROM {B} WHERE s.CHROM = b.CHROM AND s.POS = b.POS AND {_on})")(_compatible)


@query(f"SELECT site_id FROM {S} WHERE site_id % 5 = 0 AND site_id % 3 <> 0 AND site_id % 2 = 0")
def isec_compat_id(spark, d):
    a = listed(sites(spark, d)).withColumn("ID", F.when(F.col("site_id") % 5 == 0, F.concat(F.lit("rs"), "site_id")))
    return J.compatible(a, second(spark, d), "id").select("site_id")


@query(f"SELECT site_id FROM {S} WHERE NOT EXISTS (SELECT 1 FROM {B} WHERE s.CHROM = b.CHROM AND s.POS = b.POS)")
def isec_compat_lacking(spark, d):
    return J.compatible(listed(sites(spark, d)), second(spark, d), "all", inside=False).select("site_id")


@query(f"""WITH a AS (SELECT * FROM {RG} WHERE site_id % 2 = 0), b AS (SELECT *, concat(ALT1, 'GG') AS ALTB FROM {RG} WHERE site_id % 5 <> 0 AND n_alt = 1), sa AS (SELECT DISTINCT site_id, ALT1, ALT2, n_alt FROM a), sb AS (SELECT DISTINCT site_id, ALT1, ALTB FROM b),
 k AS (SELECT coalesce(sa.site_id, sb.site_id) AS site_id, sa.site_id IS NOT NULL AS in_a, sb.site_id IS NOT NULL AS in_b, CASE WHEN sa.site_id IS NULL THEN sb.ALTB WHEN sa.n_alt = 2 THEN concat(sa.ALT1, ',', sa.ALT2) ELSE sa.ALT1 END AS ra, sb.ALTB FROM sa FULL JOIN sb ON sa.site_id = sb.site_id),
 people AS (SELECT CAST(unnest(range(16)) AS INT) AS sample_id), r AS (SELECT k.*, sample_id FROM k, people)
 SELECT r.site_id, CASE WHEN in_a AND in_b THEN concat(ra, ',', r.ALTB) ELSE ra END AS alts, r.sample_id, CASE WHEN r.sample_id < 8 THEN coalesce(a.GT, './.') ELSE coalesce(CASE WHEN in_a THEN replace(b.GT, '1', CAST(len(string_split(ra, ',')) + 1 AS VARCHAR)) ELSE b.GT END, './.') END AS GT
 FROM r LEFT JOIN a ON a.site_id = r.site_id AND a.sample_id = r.sample_id LEFT JOIN b ON b.site_id = r.site_id AND b.sample_id = r.sample_id - 8""")
def merge_with_alleles(spark, d):
    a = rich(spark, d).where("site_id % 2 = 0")
    b = rich(spark, d).where("site_id % 5 <> 0").where(F.size("ALT") == 1).withColumn("ALT", F.transform("ALT", lambda x: F.concat(x, F.lit("GG"))))
    m = J.merge_records(a, b, by=["site_id"])  # the SQL tells records of a place apart by site_id
    return m.select("site_id", F.array_join("ALT", ",").alias("alts"), F.inline("samples"))


@query(f"SELECT CHROM, POS, REF, ALT, QUAL FROM {S} UNION ALL SELECT CHROM, POS, REF, concat(ALT, 'G'), QUAL FROM {S} WHERE site_id % 4 = 0")
def concat_exact_duplicates(spark, d):
    cols = ["CHROM", "POS", "REF", "ALT", "QUAL"]
    s = sites(spark, d).select(*cols)
    more = sites(spark, d).select("CHROM", "POS", "REF", F.when(F.col("site_id") % 4 == 0, F.concat("ALT", F.lit("G"))).otherwise(F.col("ALT")).alias("ALT"), "QUAL")
    return J.concatenated(s, more, duplicates="none")


@query(f"SELECT CHROM, POS, REF, ALT FROM {S}")
def concat_position_duplicates(spark, d):
    s = sites(spark, d).select(*J.SITE_KEY)
    odd, other = s.where("POS % 2 = 1"), s.withColumn("ALT", F.when(F.col("POS") % 2 == 1, "N").otherwise(F.col("ALT")))
    return J.concatenated(odd, other, duplicates="all")


@query(f"SELECT site_id, CAST(sum(p_partkey * 10) AS BIGINT) AS note FROM {OVER} WHERE least(s.POS + length(s.REF) - 1, i.e) - greatest(s.POS, i.b) + 1 >= 0.05 * (i.e - i.b + 1) AND least(s.POS + length(s.REF) - 1, i.e) - greatest(s.POS, i.b) + 1 >= 0.9 * length(s.REF) GROUP BY site_id")
def annotate_min_overlap(spark, d):
    return J.annotate_intervals(sites(spark, d), intervals(spark, d), F.col("p_partkey") * 10, "sum", of_region=0.05, of_site=0.9)


@query(f"SELECT site_id, site_id % 3 <> 0 AS seen, site_id % 3 = 0 AS unseen FROM {S}")
def annotate_mark_sites(spark, d):
    s, notes = sites(spark, d), sites(spark, d).where("site_id % 3 <> 0")
    return J.marked(J.marked(s, notes, OWN, "seen"), notes, OWN, "unseen", present=False).select("site_id", "seen", "unseen")


@query(f"SELECT site_id, CASE WHEN QUAL > 90 THEN CASE WHEN site_id % 3 <> 0 THEN -1.0 ELSE QUAL END END AS old, CASE WHEN QUAL > 90 THEN QUAL WHEN site_id % 3 <> 0 THEN -1.0 END AS gap, CASE WHEN site_id % 3 <> 0 THEN concat_ws(',', event_type, 'x') ELSE event_type END AS event_type FROM {S}")
def annotate_modes(spark, d):
    s = sites(spark, d).withColumns({"old": F.when(F.col("QUAL") > 90, F.col("QUAL")), "gap": F.when(F.col("QUAL") > 90, F.col("QUAL"))})
    notes = sites(spark, d).where("site_id % 3 <> 0").select(*OWN, F.lit(-1.0).alias("old"), F.lit(-1.0).alias("gap"), F.lit("x").alias("event_type"))
    return J.annotate(s, notes, OWN, {"old": "-", "gap": ".+", "event_type": "&"}).select("site_id", "old", "gap", "event_type")


@query(f"SELECT site_id, CASE WHEN site_id % 3 = 0 THEN concat('rs', site_id) ELSE concat(CHROM, '_', POS, '_', REF, '_', ALT1) END AS ID FROM {R}")
def annotate_set_id(spark, d):
    text = F.concat_ws("_", "CHROM", "POS", "REF", F.get("ALT", F.lit(0)))
    return T.with_id(rich(spark, d), text, only_missing=True).select("site_id", "ID")


@query(f"SELECT site_id, replace(CHROM, 'chr', '') AS CHROM, CAST(NULL AS VARCHAR) AS ID, CASE WHEN QUAL >= 20 AND QUAL <= 90 THEN 'PASS' ELSE '' END AS filters FROM {R}")
def annotate_remove_and_rename(spark, d):
    t = T.with_contigs(T.without_fields(rich(spark, d), "ID", "FILTER/q20"), {f"chr{i}": str(i) for i in range(1, 6)})
    return t.select("site_id", "CHROM", "ID", F.array_join("FILTER", ",").alias("filters"))


@query(f"""WITH seen AS (SELECT site_id, count(*) FILTER (a = 1) > 0 AS one, count(*) FILTER (a = 2) > 0 AS two FROM ({CALLS}) GROUP BY site_id)
 SELECT site_id, concat_ws(',', CASE WHEN one THEN ALT1 END, CASE WHEN two THEN ALT2 END) AS alts, sample_id, CASE WHEN two AND NOT one THEN replace(GT, '2', '1') ELSE GT END AS GT FROM {RG} JOIN seen USING (site_id)""")
def trim_unused_alts(spark, d):
    return T.without_unused_alts(rich(spark, d)).select("site_id", F.array_join("ALT", ",").alias("alts"), F.inline("samples"))


@query(f"SELECT GT LIKE '%|%' AS phased, count(*) FILTER (GT LIKE '0%') AS ref_first, count(*) FILTER (GT LIKE '_/1') AS second_alt FROM {RG} GROUP BY 1")
def gt_like(spark, d):
    return rich_tidy(spark, d).groupBy(F.col("GT").like("%|%").alias("phased")).agg(F.count_if(F.col("GT").like("0%")).alias("ref_first"), F.count_if(F.col("GT").like("_/1")).alias("second_alt"))


@query(f"SELECT site_id, n_alt AS a, n_alt + 1 AS r, CAST((n_alt + 1) * (n_alt + 2) / 2 AS INT) AS g FROM {R}")
def expected_lengths(spark, d):
    n = F.size("ALT")
    return rich(spark, d).select("site_id", *(T.LENGTHS[k](n).cast("int").alias(k.lower()) for k in "ARG"))


STUDY = f"SELECT site_id, k, ((site_id * (k + 3)) % 101 - 50) / 100.0 AS beta, (1 + (site_id + k) % 7) / 10.0 AS se, CAST(100 + 50 * k + site_id % 10 AS DOUBLE) AS size FROM {S}, (SELECT unnest(range(3)) AS k) t"


@query(f"SELECT site_id, count(*) AS n, round(sum(sqrt(size) * beta / se) / sqrt(sum(size)), 6) AS z, round(CASE WHEN sum(beta * beta / (se * se)) - pow(sum(beta / (se * se)), 2) / sum(1 / (se * se)) > 0 THEN greatest(0, 1 - (count(*) - 1) / (sum(beta * beta / (se * se)) - pow(sum(beta / (se * se)), 2) / sum(1 / (se * se)))) ELSE 0 END, 5) AS i2 FROM ({STUDY}) GROUP BY site_id")
def meta_analysis_by_size(spark, d):
    k, s = F.col("k"), F.col("site_id")
    t = sites(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("site_id", (((s * (k + 3)) % 101 - 50) / 100.0).alias("beta"), ((1 + (s + k) % 7) / 10.0).alias("se"), (100 + 50 * k + s % 10).cast("double").alias("size"))
    return A.meta_analysis_by_size(t, "site_id").select("site_id", "n", F.round("z", 6).alias("z"), F.round("i2", 5).alias("i2"))


@query(f"SELECT site_id, sample_id, CASE WHEN DP > 0 THEN round((DP - AD0) / DP, 6) END AS vaf, CASE WHEN DP > 0 THEN round(1 - AD0 / DP, 6) END AS vaf1 FROM {G}")
def read_shares(spark, d):
    t = A.with_read_shares(nested(spark, d)).select("site_id", F.inline("samples"))
    return t.select("site_id", "sample_id", F.round(F.get("VAF", F.lit(0)), 6).alias("vaf"), F.round("VAF1", 6).alias("vaf1"))


@query(f"SELECT sample_id, CAST(least(19, floor((DP - AD0) / DP * 20)) AS INT) AS bin, count(*) AS n FROM {G} WHERE DP > 0 AND GT <> './.' GROUP BY 1, 2")
def read_share_histogram(spark, d):
    t = A.with_read_shares(nested(spark, d)).select(F.inline("samples")).where("GT <> './.' AND VAF1 IS NOT NULL")
    return t.groupBy("sample_id", F.least(F.lit(19), F.floor(F.get("VAF", F.lit(0)) * 20).cast("int")).alias("bin")).agg(F.count("*").alias("n"))


@query(f"SELECT site_id, POS + length(REF) - 1 AS \"END\", CASE WHEN length(REF) = 1 AND length(ALT1) = 1 THEN CASE WHEN n_alt = 1 OR {SECOND} = 'snp' THEN 'snp' WHEN {SECOND} < 'snp' THEN concat({SECOND}, ',snp') ELSE concat('snp,', {SECOND}) END WHEN n_alt = 1 OR {SECOND} = 'indel' THEN 'indel' ELSE concat('indel,', {SECOND}) END AS type FROM {R}")
def site_tags(spark, d):
    return A.with_site_tags(rich(spark, d)).select("site_id", "END", F.array_join("TYPE", ",").alias("type"))


@query(f"SELECT site_id, CAST(max(DP) AS DOUBLE) AS top, CAST(count(*) FILTER (GQ > 50) AS DOUBLE) AS good, round(avg(GQ) / 99, 6) AS share FROM {G} GROUP BY site_id")
def tags_from_expressions(spark, d):
    t = X.with_value(X.with_value(X.with_value(nested(spark, d), "top", "MAX(DP)"), "good", "N_PASS(GQ > 50)"), "share", "AVG(GQ) / 99")
    return t.select("site_id", "top", "good", F.round("share", 6).alias("share"))


@query(f"SELECT CAST(least(4, floor(AF * 5)) AS INT) AS bin, GT AS gt1, {GT2} AS gt2, count(*) AS n FROM {G} JOIN (SELECT site_id AS k, AC / AN AS AF FROM ({FILL.format(keys='site_id', src=G)}) WHERE AN > 0) ON site_id = k WHERE site_id % 3 <> 0 GROUP BY 1, 2, 3")
def concordance_by_frequency(spark, d):
    g = genotypes(spark, d)
    af = A.fill_tags(g, "site_id").where("AN > 0").select("site_id", "AF")
    return A.concordance_by_frequency(g, other_genotypes(spark, d), af, ["site_id", "sample_id"], 5)


@query(f"SELECT concat(CHROM, chr(9), count(*) FILTER (GQ > 50 AND DP > 20), string_agg(concat(' ', GT, '=', CASE WHEN DP = 0 THEN '.' ELSE CAST(CAST(round(-10 * log10(p)) AS INT) AS VARCHAR) END), '' ORDER BY sample_id)) AS line FROM (SELECT *, CASE WHEN DP = 2 * AD0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(greatest(AD0, DP - AD0), DP + 1), lambda i: exp(lgamma(DP + 1) - lgamma(i + 1) - lgamma(DP - i + 1) - DP * ln(2))))) END AS p FROM {G}) GROUP BY site_id, CHROM")
def query_format_tests(spark, d):
    df = nested(spark, d)
    return df.select(formatting.formatted(r"%CHROM\t%N_PASS(GQ > 50 & DP > 20)[ %GT=%PBINOM(AD)]", {"GT"}, df).alias("line"))


BASE = "['A', 'C', 'G', 'T'][1 + site_id % 3]"
for _check, _sql in {
    "w": f"SELECT site_id, REF, ALT, REF = {BASE} AS ref_ok FROM {S} WHERE length(REF) = 1 AND length(ALT) = 1", "x": f"SELECT site_id, REF, ALT FROM {S} WHERE length(REF) = 1 AND length(ALT) = 1 AND REF = {BASE}",
    "s": f"SELECT site_id, {BASE} AS REF, CASE WHEN REF <> {BASE} AND ALT = {BASE} THEN REF ELSE ALT END AS ALT FROM {S} WHERE length(REF) = 1 AND length(ALT) = 1",
}.items():

    def _checked(spark, d, mode=_check):
        base = sites(spark, d).select("CHROM", "POS", "site_id", F.element_at(F.array(*map(F.lit, "ACGT")), (1 + F.col("site_id") % 3).cast("int")).alias("base"))
        t = C.checked_ref(sites(spark, d).where("length(REF) = 1 AND length(ALT) = 1"), base, ["CHROM", "POS", "site_id"], mode)  # the SQL gives every site its own base
        return t.select("site_id", "REF", "ALT", *(["ref_ok"] if mode == "w" else []))

    _checked.__name__ = f"check_ref_{_check}"
    query(_sql)(_checked)

TWICE = f"(SELECT site_id, CHROM, POS, REF, ALT FROM {S} UNION ALL SELECT site_id + 1000000, CHROM, POS, REF, {ALT_B} FROM {S}) t"
for _mode, _key in {"none": "concat(REF, '>', ALT)", "all": "''", "snps": f"CASE WHEN {TYPE.format('t')} = 'snps' THEN 'snps' ELSE concat(REF, '>', ALT) END", "both": f"CASE WHEN {TYPE.format('t')} <> 'others' THEN {TYPE.format('t')} ELSE concat(REF, '>', ALT) END"}.items():

    def _first(spark, d, mode=_mode):
        s = sites(spark, d).select("site_id", "CHROM", "POS", "REF", "ALT")
        more = s.withColumn("ALT", F.expr(ALT_B)).withColumn("site_id", F.col("site_id") + 1000000)
        return J.first_matching(listed(s.unionByName(more)), mode, "site_id").select("site_id")

    _first.__name__ = f"rm_dup_{_mode}"
    query(f"SELECT min(site_id) AS site_id FROM {TWICE} GROUP BY CHROM, POS, {_key}")(_first)


@query(f"SELECT child, site_id FROM ({TRIO_SQL}) WHERE k <> './.' AND f <> './.' AND m <> './.' AND (position(k[1] IN concat(f, m)) = 0 OR position(k[3] IN concat(f, m)) = 0)")
def trio_de_novo(spark, d):
    return trios.de_novo(nested(spark, d), TRIOS).select("child", "site_id")


@query()
def prune_sliding(spark, d):
    """At most two sites in 100 positions, those of the highest QUAL. Tested against brute force: SQL has no such state."""
    return W.prune_sliding(sites(spark, d), 100, 2, "maxAF", "QUAL").select("site_id")


@query()
def approximate_aggregates(spark, d):
    """Distinct counts and quantiles by sketches; their errors are tested, SQL's sketches are others."""
    s = sites(spark, d)
    return s.groupBy("CHROM").agg(F.approx_count_distinct("POS", 0.02).alias("n_pos"), F.percentile_approx("QUAL", [0.25, 0.5, 0.75], 10_000).alias("quartiles"), F.hll_sketch_estimate(F.hll_sketch_agg("site_id")).alias("n_sites"))


# --- SQL surface


@query(f"SELECT CHROM, stretch, CAST(len(l) AS INT) AS n, l[1] AS first, l[-1] AS last, CAST(coalesce(list_sum(list_transform(list_filter(l, lambda x: x % 2 = 0), lambda x: x * 2)), 0) AS BIGINT) AS total, list_contains(l, 100) AS has_100, CAST(list_position(l, 105) AS INT) AS at_105, array_to_string(list_slice(l, 1, 3), '-') AS head FROM (SELECT CHROM, POS // 500 AS stretch, list_sort(list(site_id)) AS l FROM {S} GROUP BY 1, 2)")
def sql_lists(spark, d):
    sites(spark, d).createOrReplaceTempView("surface_sites")
    return spark.sql("""SELECT CHROM, stretch, size(l) AS n, element_at(l, 1) AS first, element_at(l, -1) AS last, aggregate(transform(filter(l, x -> x % 2 = 0), x -> x * 2), 0L, (a, x) -> a + x) AS total, array_contains(l, 100L) AS has_100,
 nullif(cast(array_position(l, 105L) AS INT), 0) AS at_105, array_join(slice(l, 1, 3), '-') AS head FROM (SELECT CHROM, POS div 500 AS stretch, array_sort(collect_list(site_id)) AS l FROM surface_sites GROUP BY 1, 2)""")


@query("SELECT c_custkey, upper(substr(c_name, 1, 4)) AS head, length(c_name) AS n, replace(c_name, '#', ':') AS colon, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS nation, reverse(c_mktsegment) AS back, split_part(c_name, '#', 2) AS number, position('0' IN c_name) AS at, starts_with(c_mktsegment, 'A') AS a, trim(concat(' ', c_mktsegment, ' ')) AS t, regexp_replace(c_name, '[0-9]+', 'N') AS masked FROM customer")
def sql_strings(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("surface_customer")
    return spark.sql("SELECT c_custkey, upper(substr(c_name, 1, 4)) AS head, length(c_name) AS n, replace(c_name, '#', ':') AS colon, lpad(CAST(c_nationkey AS STRING), 3, '0') AS nation, reverse(c_mktsegment) AS back, split_part(c_name, '#', 2) AS number, position('0' IN c_name) AS at, startswith(c_mktsegment, 'A') AS a, trim(concat(' ', c_mktsegment, ' ')) AS t, regexp_replace(c_name, '[0-9]+', 'N', 1) AS masked FROM surface_customer")


@query("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS log, CAST(floor(p_retailprice) AS BIGINT) AS low, CAST(ceil(p_retailprice) AS BIGINT) AS high, p_size % 7 AS rest, round(pow(p_size, 2), 2) AS square, abs(p_size - 25) AS off, sign(p_size - 25) AS side, greatest(p_size, 10) AS most, p_size // 3 AS third, round(p_retailprice, 1) AS price, p_size & 6 AS bits FROM part")
def sql_math(spark, d):
    table(spark, d, "part").createOrReplaceTempView("surface_part")
    return spark.sql("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS log, floor(p_retailprice) AS low, ceil(p_retailprice) AS high, p_size % 7 AS rest, round(pow(p_size, 2), 2) AS square, abs(p_size - 25) AS off, cast(sign(p_size - 25) AS TINYINT) AS side, greatest(p_size, 10) AS most, cast(p_size div 3 AS INT) AS third, round(p_retailprice, 1) AS price, p_size & 6 AS bits FROM surface_part")


@query("""SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, count(*) AS n, min(CAST(date_trunc('month', o_orderdate) AS DATE)) AS first_month, max(CAST(o_orderdate + INTERVAL 10 DAY AS DATE)) AS last_due, CAST(sum(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01')) AS BIGINT) AS days, max(strftime(o_orderdate, '%Y/%m')) AS last
 FROM orders GROUP BY 1, 2""")
def sql_dates(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("surface_orders")
    return spark.sql("""SELECT cast(year(o_orderdate) AS BIGINT) AS y, cast(quarter(o_orderdate) AS BIGINT) AS q, count(*) AS n, min(CAST(date_trunc('month', o_orderdate) AS DATE)) AS first_month, max(CAST(o_orderdate + INTERVAL 10 DAY AS DATE)) AS last_due, sum(cast(datediff(DATE'1999-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)) AS days, max(date_format(o_orderdate, 'yyyy/MM')) AS last
 FROM surface_orders GROUP BY 1, 2""")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, {'t': event_type, 'v': value}.t AS kind, map {'a': event_id, 'b': user_id}['b'] AS b, CAST(CAST(value AS DECIMAL(12, 2)) * 3 AS DECIMAL(14, 2)) AS three, coalesce(nullif(event_type, 'view'), 'seen') AS seen, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 2 ELSE 1 END AS weight FROM events WHERE value IS NOT NULL""")
def sql_json_map_struct(spark, d):
    table(spark, d, "events").createOrReplaceTempView("surface_events")
    return spark.sql("""SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, named_struct('t', event_type, 'v', value).t AS kind, map('a', event_id, 'b', user_id)['b'] AS b, CAST(CAST(value AS DECIMAL(12, 2)) * 3 AS DECIMAL(14, 2)) AS three, coalesce(nullif(event_type, 'view'), 'seen') AS seen, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 2 ELSE 1 END AS weight FROM surface_events WHERE value IS NOT NULL""")


CTE = """WITH spent AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey), typical AS (SELECT avg(total) AS mean FROM spent)
 SELECT c.c_custkey, s.total FROM {customer} c JOIN spent s ON s.o_custkey = c.c_custkey WHERE s.total > 1.2 * (SELECT mean FROM typical) AND EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
 AND c.c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey <> 2)"""


@query(CTE.format(orders="orders", customer="customer", nation="nation"))
def sql_cte_subqueries(spark, d):
    return spark.sql(CTE, **{t: table(spark, d, t) for t in ("orders", "customer", "nation")})


@query("SELECT n.n_nationkey, c.c_custkey, s.s_suppkey FROM nation n LEFT JOIN LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n.n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) c ON true FULL JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000")
def sql_lateral_full_outer(spark, d):
    q = "SELECT n.n_nationkey, c.c_custkey, s.s_suppkey FROM {nation} n LEFT JOIN LATERAL (SELECT c_custkey FROM {customer} WHERE c_nationkey = n.n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) c ON true FULL JOIN {supplier} s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000"
    return spark.sql(q, **{t: table(spark, d, t) for t in ("nation", "customer", "supplier")})
