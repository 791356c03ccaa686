"""Results against the SQL, and against one site after another, where several sites share a place."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lociframe.operators import autozygosity as Z

IDS = [b + k for b in range(0, 240) for k in (0, 250_105, 1_000_420, 77 * 1_000_420)]  # the last two have the alleles of the first too


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("events")
    spark.createDataFrame([(i, float(i % 97), "view" if i % 3 else "click") for i in IDS], "event_id long, value double, event_type string").coalesce(1).write.parquet(f"{d}/events.parquet")
    return str(d)


@pytest.fixture(scope="module")
def con(events):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet/*.parquet'")
    return c


def both(spark, con, events, name, sql=None):
    res = con.execute(sql or entry.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    want = sorted(res.fetchall(), key=str)
    return sorted(map(tuple, entry.queries()[name](spark, events).select(*cols).collect()), key=str), want


def test_roh(spark, con, events):
    got, want = both(spark, con, events, "roh")
    assert got == want and sum(r[4] for r in want) > len(want) > 50


def test_sites_of_one_position_are_no_step_apart(spark):
    """A row per position; as with the same sites strung out, where steps don't change states but between positions."""
    schema = "CHROM string, POS long, ALT array<string>, AF double, samples array<struct<sample_id: string, GT: string>>"
    at = [(p, k) for p in range(1, 40) for k in range(1 + p % 3)]
    calls = [("c", p, ["C"], 0.3 + k / 10, [("a", "1/1" if p < 15 or k == 2 else "0/1"), ("b", "./." if p % 5 == 0 else "0/0" if p > 20 else "0/1")]) for p, k in at]
    seen = Z.observations_at_positions(spark.createDataFrame(calls, schema).repartition(4), F.col("AF"))
    assert seen.count() == 39
    runs = {r.sample_id: (r.begin, r.end, r.n) for r in Z.autozygosity(seen, 2e-3, 1e-3, block=16).collect()}
    assert runs == {"a": (1, 14, sum(p < 15 for p, _ in at)), "b": (21, 39, sum(p > 20 and p % 5 > 0 for p, _ in at))}
    states = Z.autozygosity(seen, 2e-3, 1e-3, block=16, per_site=True).collect()
    assert len(states) == sum(1 + (p % 5 > 0) for p, _ in at)


def test_frequencies_are_not_taken_in_the_tasks_that_read(spark, events):
    from lociframe.plans.derive import nested

    t = nested(spark, events, ("GT",))
    calls = F.filter(F.split(F.array_join(F.col("samples")["GT"], "/"), "/"), lambda a: a != ".")
    lines = Z.observations_at_positions(t, F.size(F.filter(calls, lambda a: a != "0")) / F.size(calls))._jdf.queryExecution().optimizedPlan().toString().split("Repartition")
    assert "_f" in lines[0] and "transform" in lines[0] and "transform" not in lines[1]


@pytest.mark.parametrize("name", ["norm_join", "norm_split"])
def test_alleles_joined_and_split(spark, con, events, name):
    """An allele that several sites of a place have is joined once for each different QUAL, and split once."""
    got, want = both(spark, con, events, name)
    assert got == want and len({len(r[3].split(",")) for r in want}) > (name == "norm_join")


PLACE = "ORDER BY POS, REF, ALT, site_id"
TIES = {  # what the SQL leaves open: sites of one position by alleles and id
    "rank_windows": lambda q: q.replace("row_number() OVER w", "row_number() OVER w2").replace("ntile(4) OVER w", "ntile(4) OVER w2") + f", w2 AS (PARTITION BY CHROM, event_type {PLACE})",
    "phase_switches": lambda q: q.replace("ORDER BY POS", "ORDER BY POS, REF, CASE WHEN n_alt = 2 THEN concat(ALT1, ',', ALT2) ELSE ALT1 END, site_id"),
}


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Events in no order, 12 of a place with equal alleles."""
    d = tmp_path_factory.mktemp("shuffled")
    ids = sorted((i for b in range(40) for i in range(b, 12 * 77 * 1_000_420, 77 * 1_000_420)), key=lambda i: hash((i, 1)))
    spark.createDataFrame([(i, float(i % 97), "view" if i % 3 else "click") for i in ids], "event_id long, value double, event_type string").coalesce(1).write.parquet(f"{d}/events.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["gvcf_blocks", "phase_switches", "rank_windows", "remove_overlaps", "remove_overlaps_late_deletions", "switch_rate"])
def test_ties_have_one_order(spark, shuffled, name):
    """Ours is the SQL's result for one order of the sites of a position; which, its ORDER BY leaves open."""
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{shuffled}/events.parquet/*.parquet'")
    got, want = both(spark, c, shuffled, name, TIES.get(name, lambda q: q.replace("ORDER BY POS", PLACE))(entry.oracle_sql()[name]))
    assert got == want
