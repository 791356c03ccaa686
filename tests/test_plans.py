"""What plans look like: windows by blocks, filters in the scan, small trees; and blocks of any width give one result."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lociframe.functions import expression, variants
from lociframe.operators import aggregates, cohort, windows
from lociframe.plans.derive import nested, sites

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def random_sites(spark, n=300, contigs=2):
    rng = random.Random(3)
    rows, seen = [], set()
    while len(rows) < n:
        at = (f"c{rng.randint(1, contigs)}", rng.randint(1, 2000))
        if at not in seen:
            seen.add(at)
            rows.append((len(rows), *at, "A" * rng.choice([1, 1, 1, 2, 9]), "A" * rng.choice([1, 1, 3]) if rng.random() < 0.3 else "C", rng.random()))
    return spark.createDataFrame(rows, "site_id int, CHROM string, POS long, REF string, ALT string, QUAL double"), rows


OPERATORS = {
    "count_near": lambda s, b: windows.count_near(s, 30, block=b).select("site_id", "n_near"), "islands": lambda s, b: windows.islands(s, 3, block=b).select("site_id", "island"),
    "indel_gap": lambda s, b: windows.indel_gap(s, 5, block=b).select("site_id", "passed"), "snp_gap": lambda s, b: windows.snp_gap(s, 5, block=b).select("site_id", "passed"),
    "without_overlaps": lambda s, b: windows.without_overlaps(s, block=b).select("site_id"), "blocks": lambda s, b: windows.blocks(s, "ALT", "REF", block=b),
    "switches": lambda s, b: windows.switches(s, "ALT", "REF", block=b),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_block_width_changes_nothing(spark, name):
    s, _ = random_sites(spark)
    narrow, wide = (sorted(map(tuple, OPERATORS[name](s, b).collect()), key=str) for b in (37, 1 << 20))
    assert narrow == wide and narrow


def test_snp_gap_brute(spark):
    s, rows = random_sites(spark)
    indels = [(c, p, p + len(r) - 1) for _, c, p, r, a, _ in rows if len(r) != len(a)]
    want = {i: not any(x == c and (b < p <= e + 5 or p < b <= p + 5) for x, b, e in indels) for i, c, p, r, a, _ in rows if len(r) == len(a)}
    assert {r.site_id: r.passed for r in windows.snp_gap(s, 5, block=64).collect()} == want


def test_neighbour_and_running_brute(spark):
    s, rows = random_sites(spark)
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    after = {a[0]: b[2] if a[1] == b[1] else None for a, b in zip(order, [*order[1:], (0, None, 0)], strict=True)}
    assert {r.site_id: r.x for r in windows.neighbour(s, "x", F.col("POS"), 1, block=50).collect()} == after
    reach = {i: max((q + len(t) - 1 for _, d, q, t, _, _ in rows if d == c and q < p), default=None) for i, c, p, _, _, _ in rows}
    assert {r.site_id: r.x for r in windows.running(s, "x", F.col("POS") + F.length("REF") - 1, F.max, False, block=50).collect()} == reach


def test_no_window_over_a_contig(spark):
    s = sites(spark, DIR)
    for name, f in OPERATORS.items():
        for spec in re.findall(r"windowspecdefinition\(([^)]*)", plan(f(s, windows.BLOCK))):
            over = spec.split(" ASC")[0]
            # carried values go over one row a block: ordered by _b
            assert "_b#" in spec or "island" in over, (name, spec)


def test_comparisons_reach_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id AS site_id", "'A' AS REF", "array('C') AS ALT", "cast(id AS double) / 7 AS QUAL").write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    for text, pushed in (('QUAL > 99 && TYPE = "snp"', "GreaterThanOrEqual(QUAL"), ("QUAL <= 3.3", "LessThanOrEqual(QUAL"), ("QUAL = 2", "GreaterThanOrEqual(QUAL"), ("9 < QUAL", "GreaterThanOrEqual(QUAL")):
        got = expression.include(df, text)
        assert pushed in got._jdf.queryExecution().executedPlan().toString(), text
    single = lambda x: float(__import__("numpy").float32(x))
    for op, test in ((">", lambda x, y: x > y), (">=", lambda x, y: x >= y), ("<", lambda x, y: x < y), ("=", lambda x, y: x == y), ("!=", lambda x, y: x != y)):
        for c in (0.1, 3.3, 14.142857142857142, 100):
            assert expression.include(df, f"QUAL {op} {c}").count() == sum(test(single(i / 7), single(c)) for i in range(1000)), (op, c)


def test_small_trees(spark):
    df = nested(spark, DIR)
    assert len(plan(expression.include(df, 'QUAL > 50 && TYPE = "snp"'))) < 20_000
    assert len(plan(df.select(variants.types(F.col("REF"), F.col("ALT"))))) < 20_000


def test_cohorts_of_many_samples(spark):
    rng = random.Random(1)
    rows = [(s, i, rng.choice(["0/0", "0/1", "1|1", "./.", "1/2"])) for s in range(20) for i in range(70)]
    tidy = spark.createDataFrame(rows, "site_id int, sample_id int, GT string")
    dose = {(s, i): sum(a not in "0." for a in g[::2]) for s, i, g in rows if g != "./."}
    small = tidy.where("sample_id < 8")
    want = {}
    for a in range(8):
        for b in range(a + 1, 8):
            both = [(dose[s, a], dose[s, b]) for s in range(20) if (s, a) in dose and (s, b) in dose]
            want[a, b] = len(both), sum(x == y for x, y in both)
    assert {(r.a, r.b): (r.n_sites, r.n_same) for r in aggregates.concordance(small, 3).collect()} == want
    groups = {}
    for s, i, g in rows:
        if g != "./.":
            groups.setdefault((s, g), []).append(i)
    got = {tuple(r.samples): r.n for r in aggregates.genotype_intersections(tidy).collect()}
    assert sum(got.values()) == len(groups) and all(got[tuple(sorted(v))] for v in groups.values())
    merged = cohort.merged_samples(tidy, small, ["site_id"])
    assert merged.count() == 20 * 78 and merged.where("sample_id = 70 and site_id = 4").first().GT == next(g for s, i, g in rows if (s, i) == (4, 0))
