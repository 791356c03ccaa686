"""Registered queries over sites with several ALTs and genotypes of all kinds, with DuckDB SQL written from the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociframe.functions import expression as X
from lociframe.functions import variants as V
from lociframe.operators import aggregates as A
from lociframe.operators import selection as L
from lociframe.operators import transforms as T
from lociframe.operators import windows as W
from lociframe.plans.derive import RGT, RSITE, intervals, nested, rich, rich_tidy, sites
from lociframe.queries import G, I, S, query

R, RG = f"({RSITE}) r", f"({RGT}) q"
# alleles of every genotype: a row each, null where missing
CALLS = f"SELECT site_id, sample_id, n_alt, TRY_CAST(unnest(string_split_regex(GT, '[/|]')) AS INT) AS a FROM {RG}"
COUNTS = f"SELECT site_id, i, count(*) FILTER (a = i) AS n FROM ({CALLS}) c, (SELECT unnest(range(3)) AS i) t WHERE i <= n_alt GROUP BY site_id, i"
PER = f"SELECT site_id, CAST(sum(n) AS BIGINT) AS an, CAST(sum(n) FILTER (i > 0) AS BIGINT) AS nref, max(n) FILTER (i = 1) AS alt1, min(n) AS minor, max(n) AS major FROM ({COUNTS}) GROUP BY site_id"


# type of the second ALT, the first one with TT: another base before it makes it other, unless REF ends as it does
SECOND = "CASE WHEN length(REF) = 3 THEN 'mnp' WHEN REF = ALT1[1] OR REF = 'T' THEN 'indel' ELSE 'other' END"


def _select(name: str, sql: str, where, source=rich):
    def run(spark, d):
        return source(spark, d).where(where()).select("site_id")

    run.__name__ = name
    query(sql)(run)


_select("view_filter_list", f"SELECT site_id FROM {R} WHERE QUAL IS NULL OR QUAL < 20 OR QUAL > 90", lambda: L.filtered([".", "q20"]))
_select("view_known", f"SELECT site_id FROM {R} WHERE site_id % 3 = 0", lambda: L.known())
_select("view_novel", f"SELECT site_id FROM {R} WHERE site_id % 3 <> 0", lambda: ~L.known())
_select("view_min_alleles", f"SELECT site_id FROM {R} WHERE n_alt >= 2", lambda: L.allele_number(3))
_select("view_biallelic", f"SELECT site_id FROM {R} WHERE n_alt = 1", lambda: L.allele_number(2, 2))
_select("view_types", f"SELECT site_id FROM {R} WHERE length(REF) <> length(ALT1) OR n_alt = 2 AND {SECOND} = 'indel'", lambda: L.of_type("indel"))
_select("view_exclude_types", f"SELECT site_id FROM {R} WHERE length(REF) = length(ALT1) AND n_alt = 1", lambda: ~L.of_type("indel", "mnp", "other"))
for _kind, _sql in {"nref": "nref", "alt1": "alt1", "minor": "minor", "major": "major", "nonmajor": "an - major"}.items():
    _select(f"view_count_{_kind}", f"SELECT site_id FROM ({PER}) WHERE {_sql} BETWEEN 2 AND 6", lambda k=_kind: L.count_between(2, 6, k))
    _select(f"view_frequency_{_kind}", f"SELECT site_id FROM ({PER}) WHERE an > 0 AND ({_sql}) / an BETWEEN 0.2 AND 0.6", lambda k=_kind: L.frequency_between(0.2, 0.6, k))
HAS = "SELECT site_id FROM (SELECT site_id, sample_id, count(*) AS n, count(a) AS k, count(DISTINCT a) AS m FROM ({calls}) GROUP BY site_id, sample_id) GROUP BY site_id HAVING {not_} bool_or({test})"
_select("view_has_hom", HAS.format(calls=CALLS, not_="", test="n = k AND n > 1 AND m = 1"), lambda: L.has_genotype("hom"))
_select("view_no_het", HAS.format(calls=CALLS, not_="NOT", test="n = k AND m > 1"), lambda: ~L.has_genotype("het"))
_select("view_no_missing", HAS.format(calls=CALLS, not_="NOT", test="k < n"), lambda: ~L.has_genotype("miss"))
_select("view_phased", f"SELECT site_id FROM {RG} GROUP BY site_id HAVING bool_and(GT NOT LIKE '%/%')", lambda: L.all_phased())
_select("view_uncalled", f"SELECT site_id FROM ({CALLS}) GROUP BY site_id HAVING count(a) = 0", lambda: L.uncalled())
_select("view_private", f"SELECT site_id FROM ({CALLS}) GROUP BY site_id HAVING count(*) FILTER (a > 0 AND sample_id IN (1, 4)) > 0 AND count(*) FILTER (a > 0 AND sample_id NOT IN (1, 4)) = 0", lambda: L.private_to([1, 4]))
for _over, _begin, _end in (("pos", "r.POS", "r.POS"), ("record", "r.POS", "r.POS + length(r.REF) - 1"), ("variant", "CASE WHEN length(r.REF) <> length(r.ALT1) AND r.REF[1] = r.ALT1[1] AND (n_alt = 1 OR length(r.REF) <> length(r.ALT2) AND r.REF[1] = r.ALT2[1]) THEN least(r.POS + 1, r.POS + length(r.REF) - 1) ELSE r.POS END", "r.POS + length(r.REF) - 1")):
    for _inside in (True, False):

        def _targets(spark, d, over=_over, inside=_inside):
            return L.in_targets(rich(spark, d), intervals(spark, d).toDF("k2", "c2", "b2", "e2"), over, inside).select("site_id")

        _targets.__name__ = f"view_{'' if _inside else 'not_'}targets_{_over}"
        query(f"SELECT site_id FROM {R} WHERE {'' if _inside else 'NOT'} EXISTS (SELECT 1 FROM {I} WHERE i.c = r.CHROM AND {_begin} <= i.e AND i.b <= {_end})")(_targets)


# --- genotype aggregates with several ALTs, haploid and half-missing calls

GROUPED = f"SELECT site_id, sample_id, n_alt, count(*) AS n, count(a) AS k, count(DISTINCT a) AS m, list(a) FILTER (a IS NOT NULL) AS got FROM ({CALLS}) GROUP BY site_id, sample_id, n_alt"
TAGS = f"""SELECT site_id, i, count(*) FILTER (list_contains(got, i)) AS carriers, CAST(sum(len(list_filter(got, lambda x: x = i))) AS BIGINT) AS ac, CAST(sum(CASE WHEN m > 1 AND list_contains(got, i) THEN 1 ELSE 0 END) AS BIGINT) AS het,
 CAST(sum(CASE WHEN m = 1 AND k > 1 AND list_contains(got, i) THEN 2 ELSE 0 END) AS BIGINT) AS hom, CAST(sum(CASE WHEN m = 1 AND k = 1 AND list_contains(got, i) THEN 1 ELSE 0 END) AS BIGINT) AS hemi
 FROM (SELECT * REPLACE (coalesce(got, []) AS got) FROM ({GROUPED})), (SELECT unnest(range(3)) AS i) t WHERE i <= n_alt GROUP BY site_id, i"""
JOINED = lambda c: f"string_agg(CAST({c} AS VARCHAR), ',' ORDER BY i) FILTER (i > 0)"


@query(f"SELECT site_id, CAST(sum(ac) AS BIGINT) AS AN, {JOINED('ac')} AS AC, {JOINED('het')} AS AC_Het, {JOINED('hom')} AS AC_Hom, {JOINED('hemi')} AS AC_Hemi, round(CASE WHEN sum(ac) > 0 THEN list_sort(list(ac), 'DESC')[2] / sum(ac) ELSE 0 END, 6) AS MAF FROM ({TAGS}) GROUP BY site_id")
def fill_tags_multiallelic(spark, d):
    t = A.fill_tags_by_allele(rich(spark, d))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return t.select("site_id", F.col("AN").cast("long").alias("AN"), *(text(c) for c in ("AC", "AC_Het", "AC_Hom", "AC_Hemi")), F.round("MAF", 6).alias("MAF"))


@query(f"SELECT count(*) AS records, CAST(0 AS BIGINT) AS no_alts, count(*) FILTER (length(REF) = 1 AND length(ALT1) = 1) AS snps, count(*) FILTER (n_alt = 2 AND {SECOND} = 'mnp') AS mnps, count(*) FILTER (length(REF) <> length(ALT1) OR n_alt = 2 AND {SECOND} = 'indel') AS indels, count(*) FILTER (n_alt = 2 AND {SECOND} = 'other') AS others, count(*) FILTER (n_alt = 2) AS multiallelic FROM {R}")
def record_types_multiallelic(spark, d):
    return A.record_types(rich(spark, d))


@query(f"SELECT k, count(*) AS n FROM (SELECT CASE WHEN k < n THEN 'mis' WHEN n = 1 THEN CASE WHEN list_contains(got, 0) THEN 'hap_ref' ELSE 'hap_alt' END WHEN m = 1 THEN CASE WHEN list_contains(got, 0) THEN 'hom_ref' ELSE 'hom_alt' END WHEN list_contains(got, 0) THEN 'het_ref' ELSE 'het_alt' END AS k FROM ({GROUPED})) GROUP BY k")
def genotype_classes(spark, d):
    return rich_tidy(spark, d).select(V.genotype_class(F.col("GT")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query(f"SELECT site_id, CHROM, POS, REF, ALT, sample_id, CAST(i AS INT) AS allele, CASE WHEN GT LIKE '%|%' THEN array_to_string(list_transform(string_split_regex(GT, '[/|]'), lambda x: CASE WHEN x = '0' THEN '0' WHEN x = CAST(i AS VARCHAR) THEN '1' ELSE '.' END), '|') ELSE array_to_string(list_transform(string_split_regex(GT, '[/|]'), lambda x: CASE WHEN x = '0' THEN '0' WHEN x = CAST(i AS VARCHAR) THEN '1' ELSE '.' END), '/') END AS GT FROM (SELECT * FROM (SELECT *, unnest(CASE WHEN n_alt = 1 THEN [ALT1] ELSE [ALT1, ALT2] END) AS ALT, unnest(CASE WHEN n_alt = 1 THEN [1] ELSE [1, 2] END) AS i FROM {RG}))")
def norm_split_genotypes(spark, d):
    return T.split_genotypes(rich(spark, d)).select("site_id", "CHROM", "POS", "REF", "ALT", "allele", F.inline("samples")).select("site_id", "CHROM", "POS", "REF", "ALT", "sample_id", "allele", "GT")


@query(f"SELECT sample_id, count(*) AS n_pairs, count(*) FILTER (phase <> before) AS n_switches FROM (SELECT *, lag(phase) OVER (PARTITION BY sample_id, CHROM ORDER BY POS) AS before FROM (SELECT *, GT[1] < GT[3] AS phase FROM {RG} WHERE length(GT) = 3 AND GT LIKE '%|%' AND GT[1] <> GT[3])) WHERE before IS NOT NULL GROUP BY sample_id")
def phase_switches(spark, d):
    return W.phase_switches(rich_tidy(spark, d))


@query(f"SELECT site_id FROM (SELECT *, lead(hit) OVER w AS nxt FROM (SELECT *, coalesce(POS + CASE WHEN length(REF) > length(ALT) THEN 1 ELSE 0 END <= max(POS + length(REF) - 1) OVER (PARTITION BY CHROM ORDER BY POS ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS hit FROM {S}) WINDOW w AS (PARTITION BY CHROM ORDER BY POS)) WHERE NOT hit AND NOT coalesce(nxt, false)")
def remove_overlaps_late_deletions(spark, d):
    return W.without_overlaps(sites(spark, d), deletions_late=True).select("site_id")


@query(f"WITH p AS (SELECT CHROM, POS, site_id FROM {S} UNION ALL SELECT CHROM, POS, site_id + 1000000 FROM {S} WHERE site_id % 10 = 0) SELECT site_id FROM p WHERE (CHROM, POS) IN (SELECT (CHROM, POS) FROM p GROUP BY CHROM, POS HAVING count(*) > 1)")
def same_position(spark, d):
    s = sites(spark, d).select("CHROM", "POS", "site_id")
    return W.same_position(s.unionByName(s.where("site_id % 10 = 0").withColumn("site_id", F.col("site_id") + 1000000))).select("site_id")


FISHER = f"""WITH t AS (SELECT site_id, sample_id, AD0 AS a, DP - AD0 AS b, GQ % 20 AS c, DP % 7 AS e FROM {G}), p AS (SELECT *, -(lgamma(i + 1) + lgamma(a + b - i + 1) + lgamma(a + c - i + 1) + lgamma(e - a + i + 1)) AS lp FROM (SELECT *, unnest(range(greatest(0, a - e), least(a + b, a + c) + 1)) AS i FROM t)),
 w AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY site_id, sample_id)) AS w FROM p), o AS (SELECT site_id, sample_id, max(w) AS own FROM w WHERE i = a GROUP BY 1, 2), f AS (SELECT site_id, sample_id, least(1, sum(w) FILTER (w <= own * (1 + 1e-7)) / sum(w)) AS p FROM w JOIN o USING (site_id, sample_id) GROUP BY 1, 2)
 SELECT site_id, CAST(count(*) FILTER (CAST(p AS FLOAT) < CAST(0.05 AS FLOAT)) AS INT) AS n_samples FROM f GROUP BY site_id HAVING bool_or(CAST(p AS FLOAT) < CAST(0.05 AS FLOAT))"""


@query(FISHER)
def expr_fisher(spark, d):
    four = lambda s: F.struct(s["sample_id"].alias("sample_id"), s["GT"].alias("GT"), F.array(F.get(s["AD"], F.lit(0)), F.get(s["AD"], F.lit(1)), s["GQ"] % 20, s["DP"] % 7).alias("X4"))
    r = X.with_result(nested(spark, d).withColumn("samples", F.transform("samples", four)), "FISHER(X4) < 0.05")
    return r.where("pass_site").select("site_id", F.size(F.filter("pass_samples", lambda x: x)).alias("n_samples"))
