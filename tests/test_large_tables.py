"""What queries carry and give once several sites share a place, as in larger tables."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lociframe.functions import expression as X
from lociframe.functions import variants as V
from lociframe.operators import alleles as L
from lociframe.operators import joins as J
from lociframe.operators import sequence as Q


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fetched_bases_leave_their_block_at_the_join(spark):
    """An aggregate that cuts the bases itself is given whole blocks, and writes one a row to disk when it spills."""
    reference = spark.createDataFrame([("c", 0, "ACGTACGT"), ("c", 1, "TTGG")], "CHROM string, block long, bases string")
    rows = spark.createDataFrame([("c", 7, 10), ("c", 2, 3)], "CHROM string, b long, e long")
    got = Q.fetched(rows, reference, F.col("b"), F.col("e"), "found", 8)
    assert sorted(r.found for r in got.collect()) == ["CG", "GTTT"]
    gathered = [x for x in plan(got).splitlines() if "collect_list" in x]
    assert gathered and not any("substring" in re.sub(r"#\d+", "", x) for x in gathered)


def test_left_alignment_carries_few_bases(spark, monkeypatch):
    """A site is sent with the bases before it, not with two blocks; longer repeats go on in further rounds."""
    shifted, seen = Q.shifted, spark.sparkContext.accumulator(0)

    def measured(pos, alleles, bases, first):
        seen.add(len(bases))
        return shifted(pos, alleles, bases, first)

    monkeypatch.setattr(Q, "shifted", measured)
    text = "G" + "A" * 300 + "C" + "ACGT" * 500
    reference = Q.in_pieces(spark.createDataFrame([("c", 0, text)], "CHROM string, begin long, bases string"), 1024)
    sites = spark.createDataFrame([(1, "c", 290, "AA", ["A"]), (2, "c", 1500, text[1499:1501], [text[1499]])], "i int, CHROM string, POS long, REF string, ALT array<string>")
    got = {r.i: (r.POS, r.REF, r.ALT) for r in Q.left_aligned(sites, reference, 1024).collect()}
    assert got == {1: (1, "GA", ["G"]), 2: (1500, text[1499:1501], [text[1499]])}
    assert 0 < seen.value < 2 * (2 * 128 + 290)  # a checkpoint computes its rows twice


def test_linkage_of_positions_with_several_records(spark):
    """Without alleles a position is one site, and each of a sample's dosages there is paired with each at the other."""
    rng = random.Random(5)
    rows = [("c", p, s, rng.choice([0, 1, 2, None])) for p in (3, 9, 9, 9, 20, 20, 33) for s in range(6)]
    df = spark.createDataFrame(rows, "CHROM string, POS long, sample_id int, d int")
    got = {(r.pos1, r.pos2): (r.n, None if r.r2 is None else round(r.r2, 9)) for r in J.linkage(df, F.col("d"), 15).where("n > 0").collect()}
    want = {}
    for p, q in ((3, 9), (9, 20), (20, 33)):
        both = [(x, y) for _, a, s, x in rows for _, b, u, y in rows if (a, b) == (p, q) and s == u and x is not None and y is not None]
        n, sx, sy = len(both), sum(x for x, _ in both), sum(y for _, y in both)
        vx, vy = n * sum(x * x for x, _ in both) - sx * sx, n * sum(y * y for _, y in both) - sy * sy
        want[p, q] = (n, round((n * sum(x * y for x, y in both) - sx * sy) ** 2 / (vx * vy), 9) if vx and vy else None)
    assert got == want


def test_work_on_samples_is_done_once_and_after_the_deal(spark):
    """A filter on an aggregate over samples is not pushed into the tasks that read, and a mean is not taken anew for every value."""
    t = spark.range(8).selectExpr("id AS site_id", "array(named_struct('sample_id', 0, 'DP', cast(id as int)), named_struct('sample_id', 1, 'DP', 4)) AS samples").repartition(3)
    got = X.with_result(t, "STDEV(DP) > 1").where("pass_site")
    assert sorted(r.site_id for r in got.collect()) == [0, 1, 7]
    before, after = plan(got).split("Repartition")[:2]
    assert "Filter pass_site" in before and "Filter" not in after


def test_binomial_test_takes_one_pass(spark):
    rows = [(0, 0), (3, 0), (0, 7), (5, 5), (12, 30), (900, 1100), (None, 2)]
    got = [r[0] for r in spark.createDataFrame(rows, "a int, b int").select(V.binomial_test(F.col("a"), F.col("b"))).collect()]
    exact = lambda a, b: None if a is None or a + b == 0 else min(1.0, 1.0 if a == b else 2 * sum(math.comb(a + b, k) for k in range(max(a, b), a + b + 1)) / 2 ** (a + b))
    assert all(g is None if w is None else math.isclose(g, w, rel_tol=1e-9) for g, w in zip(got, (exact(*r) for r in rows), strict=True))
    n, top = 400_400, 200_400  # a sum that began anew for every term would take hours
    log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    p = spark.createDataFrame([(top, n - top)], "a int, b int").select(V.binomial_test(F.col("a"), F.col("b"))).first()[0]
    assert math.isclose(p, 2 * sum(math.exp(log(k)) for k in range(top, top + 20_000)), rel_tol=1e-6)


def test_intersection_of_repeated_records(spark):
    rows = lambda *p: spark.createDataFrame([("c", x, "A", "T") for x in p], "CHROM string, POS int, REF string, ALT string")
    got = J.intersection(rows(1, 1, 2, 3), rows(1, 1, 1, 3, 4), count="=2", repeated=True).select("POS").collect()
    assert sorted(r.POS for r in got) == [1] * 6 + [3]


def test_sites_are_told_apart_at_one_place(spark, tmp_path):
    """Events 1,000,420 apart, and 250,105 apart, share a place; the first pair has equal alleles too."""
    import __spark_entry__ as entry

    ids = [5, 5 + 250_105, 5 + 1_000_420, 5 + 11 * 7 * 3 * 1_000_420]
    spark.createDataFrame([(i, float(i % 90), "view") for i in ids], "event_id long, value double, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    assert len(run("annotate_renamed")) == len(run("annotate_modes")) == len(run("annotate_sites")) == len(run("merge_info")) == len(ids)
    assert len(run("check_ref_w")) == sum(1 for i in ids if i % 7 and i % 11)
    assert len(run("isec_complement")) == sum(i % 3 == 0 for i in ids)


def test_merging_tells_sites_of_one_place_apart(spark):
    """Two SNPs at one place, of two sites, each with its own deletion in the second set: an id keeps the pairs together."""
    sample = [(0, "0/1")]
    schema = "site_id int, CHROM string, POS int, REF string, ALT array<string>, samples array<struct<sample_id: int, GT: string>>"
    a = spark.createDataFrame([(1, "c", 5, "A", ["T"], sample), (2, "c", 5, "C", ["G"], sample)], schema)
    b = spark.createDataFrame([(1, "c", 5, "AT", ["A"], sample), (2, "c", 5, "CT", ["C"], sample), (3, "c", 5, "AT", ["A"], sample)], schema)
    rows = L.merge_calls(a, b, by=["site_id"]).collect()
    assert sorted((r.site_id, r.REF, r.ALT) for r in rows) == [(1, "AT", ["TT", "A"]), (2, "CT", ["GT", "C"]), (3, "AT", ["A"])]
    rows = L.merge_calls(a, b, policy="both", by=["site_id"]).collect()
    assert sorted((r.site_id, r.REF, *(s.GT for s in r.samples)) for r in rows) == [(1, "A", "0/1", "./."), (1, "AT", "./.", "0/1"), (2, "C", "0/1", "./."), (2, "CT", "./.", "0/1"), (3, "AT", "./.", "0/1")]
    assert len(J.merge_records(a, b, by=["site_id"]).collect()) == 3


def test_interval_notes_make_no_pairs(spark):
    """Combined by stretches of positions, as over all pairs; long intervals, longer REFs and values that are missing too."""
    rng = random.Random(3)
    sites = [(i, f"c{rng.randrange(2)}", rng.choice([p, p + 4096]), "A" * rng.choice([1, 1, 3, 9, 40])) for i, p in enumerate(rng.randrange(1, 120) for _ in range(150))]
    regions = [(i, f"c{rng.randrange(3)}", b, b + rng.choice([0, 1, 7, 8, 63, 500, 5000]), rng.choice([None, i * 3 % 17])) for i, b in enumerate(rng.randrange(-9, 130) for _ in range(80))]
    s, r = spark.createDataFrame(sites, "site_id int, CHROM string, POS int, REF string"), spark.createDataFrame(regions, "p_partkey int, c string, b int, e int, v int")
    over = {i: [x for x in regions if x[1] == c and x[2] <= p + len(ref) - 1 and x[3] >= p] for i, c, p, ref in sites}
    known = lambda xs: [x[4] for x in xs if x[4] is not None]
    rules = {"first": lambda xs: min(xs)[4], "sum": lambda xs: sum(known(xs)) if known(xs) else None, "avg": lambda xs: sum(known(xs)) / len(known(xs)) if known(xs) else None, "min": lambda xs: min(known(xs), default=None), "max": lambda xs: max(known(xs), default=None)}
    for logic, rule in rules.items():
        got = J.annotate_intervals(s, r, F.col("v"), logic)
        assert {x.site_id: x.note for x in got.collect()} == {i: rule(xs) for i, xs in over.items() if xs}
        assert "_bin" not in plan(got)


def test_probabilities_are_taken_once(spark):
    from lociframe.operators import cohort as C
    from lociframe.operators import transforms as T

    t = spark.createDataFrame([(1, [((0.0, 10.0, 20.0),)])], "site_id int, samples array<struct<PL: struct<a: double, b: double, c: double>>>")
    got = C.imputation_quality(t, lambda s: T.probabilities(T.likelihoods_from_phred(F.array(s["PL"]["a"], s["PL"]["b"], s["PL"]["c"]))))
    assert plan(got).upper().count("POW") == 1 and math.isclose(got.first().info, 1 - (0.14 / 1.11 - (0.12 / 1.11) ** 2) / (2 * (0.06 / 1.11) * (1 - 0.06 / 1.11)))


def test_longer_tables_are_dealt_to_more_tasks(spark, tmp_path):
    from lociframe.plans import derive

    spark.range(0, 1000, 1, 9).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert derive.spread(t).rdd.getNumPartitions() >= 16 * t.rdd.getNumPartitions()


def test_joins_by_site_give_the_results_of_their_sql_where_places_repeat(spark, tmp_path):
    """Pairs 1,000,420 events apart have equal alleles at one place, those 250,105 apart share the place alone."""
    import duckdb

    import __spark_entry__ as entry

    ids = [b + k for b in range(0, 60, 2) for k in (0, 250_105, 1_000_420, 77 * 1_000_420)]
    spark.createDataFrame([(i, float(i % 97), "view") for i in ids], "event_id long, value double, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("annotate_renamed", "annotate_sites", "check_ref_s", "check_ref_w", "isec_eq2", "isec_exact_sets"):
        res = con.execute(entry.oracle_sql()[name])
        cols = [c[0] for c in res.description]
        got = entry.queries()[name](spark, str(tmp_path)).select(*cols).collect()
        assert sorted(map(tuple, got), key=str) == sorted(res.fetchall(), key=str), name


@pytest.mark.parametrize("name", ["fixref_stats", "isec_compat_id", "isec_compat_lacking", "isec_compat_none", "isec_compat_some", "stats_two_files"])
def test_queries_that_share_the_step_give_the_results_of_their_sql_where_places_repeat(spark, tmp_path, name):
    import duckdb

    import __spark_entry__ as entry

    ids = [b + k for b in range(0, 60, 2) for k in (0, 250_105, 1_000_420, 77 * 1_000_420)]
    spark.createDataFrame([(i, float(i % 97), "view") for i in ids], "event_id long, value double, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    res = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).select(*cols).collect()), key=str) == sorted(res.fetchall(), key=str)


def test_bins_of_an_overlap_join_are_dealt_to_many_tasks(spark):
    """Pairs may be many times as large as both sides, whose bytes would leave them to a few tasks."""
    i = spark.range(0, 4000, 1, 1).selectExpr("id", "'c' AS c", "id * 5 % 3001 AS b", "id * 5 % 3001 + 40 AS e")
    pairs = J.overlap_join(i, i.toDF("k2", "c2", "b2", "e2"), 64, 24)
    sizes = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 12 and max(r["count"] for r in sizes) < sum(r["count"] for r in sizes) / 6
    assert pairs.count() == i.crossJoin(i.toDF("k2", "c2", "b2", "e2")).where("b <= e2 AND b2 <= e").count()


def test_sites_of_one_span_meet_the_intervals_once_in_pairs_too(spark):
    rng = random.Random(8)
    sites = [(i, "c", p, p + rng.choice([0, 0, 2, 70])) for i, p in enumerate(rng.choice([3, 64, 65, 127, 128, 300]) for _ in range(120))]
    regions = [(i, rng.choice("cd"), b, b + rng.choice([0, 10, 200])) for i, b in enumerate(rng.randrange(310) for _ in range(60))]
    s, r = spark.createDataFrame(sites, "k int, c string, b int, e int"), spark.createDataFrame(regions, "i int, c2 string, b2 int, e2 int")
    got = J.overlap_pairs(s, r, "k", 64, 5)
    assert sorted((x.k, x.i) for x in got.collect()) == sorted((k, i) for k, c, b, e in sites for i, d, f, g in regions if c == d and b <= g and f <= e)
    lines = [re.sub(r"#\d+", "", x) for x in plan(got).splitlines()]
    assert any("explode(_keys)" in x for x in lines[: next(n for n, x in enumerate(lines) if "Join" in x)])  # after the join, not before it


def test_texts_of_intervals_are_gathered_in_many_tasks(spark):
    sites = spark.range(0, 200, 1, 1).selectExpr("id AS site_id", "'c' AS CHROM", "1 + id % 50 AS POS", "'A' AS REF")
    regions = spark.range(0, 90, 1, 1).selectExpr("id AS p_partkey", "'c' AS c", "id % 45 AS b", "id % 45 + 3 AS e")
    got = J.annotate_intervals(sites, regions, F.col("p_partkey"), "append", tasks=7)
    assert plan(got).count("RepartitionByExpression") == 2
    want = {i: ",".join(sorted(str(p) for p in range(90) if p % 45 <= 1 + i % 50 <= p % 45 + 3)) for i in range(200)}
    assert {r.site_id: r.note for r in got.collect()} == {i: t for i, t in want.items() if t}


def test_what_a_record_shares_is_not_taken_anew_for_every_sample(spark):
    """Places of pairs of alleles depend on the record alone; a table's margins, and every weight, are worked out in one place."""
    schema = "site_id int, CHROM string, POS int, REF string, ALT array<string>, samples array<struct<sample_id: int, GT: string, PL: array<int>>>"
    t = spark.createDataFrame([(1, "c", 5, "A", ["T", "G"], [(i, g, [1, 2, 3, 4, 5, 6]) for i, g in enumerate(["0/2", "2|1", "1", ".", "./2", "0/0/2"])])], schema)
    got = L.split_records(t)
    assert {r.allele: ([s.GT for s in r.samples], r.samples[0].PL) for r in got.collect()} == {1: (["0/.", ".|1", "1", ".", "./.", "0/0/."], [1, 2, 3]), 2: (["0/1", "1|.", ".", ".", "./1", "0/0/1"], [1, 4, 6])}
    lines = plan(got).splitlines()
    assert any("greatest" in x for x in lines) and not any("greatest" in x and "GT" in x for x in lines)
    p = spark.createDataFrame([(3, 1, 1, 3), (0, 0, 0, 0), (8, 2, 1, 5), (5, 0, 1, 4)], "a int, b int, c int, d int").select(V.fisher(*map(F.col, "abcd")).alias("p"))
    assert [round(r.p, 9) for r in p.collect()] == [0.485714286, 1.0, 0.034965035, 0.047619048]
    assert plan(p).count("element_at") <= 2
