"""Overlaps resolved by the lowest value, and indel chains by allele counts, against one site after another."""

import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import windows

SCHEMA = "site_id int, CHROM string, POS long, REF string, ALT string, QUAL double, INFO_DP int"


def data(seed, n=250):
    rng = random.Random(seed)
    return [(i, rng.choice("xy"), rng.randint(1, 900), "A" * rng.choice([1, 1, 2, 5, 40]), rng.choice(["C", "CG", "T"]) + str(i), rng.choice([None, 1.0, 1.0, 2.0, rng.random()]), rng.randint(1, 40)) for i in range(n)]


def one_by_one(rows, value):
    left = {r[0]: r for r in rows}
    order = sorted(rows, key=lambda r: (r[2], r[3], r[4]))
    order = sorted(reversed(order), key=value)  # the lowest first, of equals the later site
    for r in order:
        if any(o[0] != r[0] and o[1] == r[1] and o[2] <= r[2] + len(r[3]) - 1 and r[2] <= o[2] + len(o[3]) - 1 for o in left.values()):
            del left[r[0]]
    return set(left)


@pytest.mark.parametrize("width", [8, 1024])
def test_lowest_go_first(spark, width):
    rows = data(width)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = one_by_one(rows, lambda r: r[5] or 0.0)
    assert {r.site_id for r in windows.without_lower_overlaps(df, width=width).collect()} == want and len(want) > 5
    marked = windows.without_lower_overlaps(df, width=width, mark="gone")
    assert marked.count() == len(rows) and {r.site_id for r in marked.where("not gone").collect()} == want
    assert windows.without_lower_overlaps(df.where("false")).count() == 0


def test_missing_values_by_depth(spark):
    rows = data(7, 120)
    df = spark.createDataFrame(rows, SCHEMA)
    chains, value = [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        if not chains or chains[-1][0][1] != r[1] or r[2] > max(o[2] + len(o[3]) - 1 for o in chains[-1]):
            chains.append([])
        chains[-1].append(r)
    for chain in chains:
        top = max((r[5] for r in chain if r[5] is not None), default=None)
        depths = {r[6] for r in chain if r[5] == top}
        for r in chain:
            value[r[0]] = r[5] if r[5] is not None else 0.0 if top is None else (top * r[6] / next(iter(depths)) if len(depths) == 1 else None)
    plain = [r for chain in chains if all(value[r[0]] is not None for r in chain) for r in chain]
    ids = [r[0] for r in plain]
    got = {r.site_id for r in windows.without_lower_overlaps(df.where(F.col("site_id").isin(ids)), missing="DP").collect()}
    assert got == one_by_one(plain, lambda r: value[r[0]])


def test_indel_chains_by_count(spark):
    rng = random.Random(1)
    rows = [(i, "x", p, "AA", "A", rng.choice([None, 0.0, -1.0]) if p < 500 else rng.choice([None, 5.0, 7.0]), rng.randint(0, 9)) for i, p in enumerate(sorted(rng.sample(range(1, 1000), 150)))]
    chains = []
    for r in rows:
        if not chains or r[2] > max(o[2] + 1 for o in chains[-1]) + 3:
            chains.append([])
        chains[-1].append(r)
    want = set()
    for c in chains:
        by = (lambda r: -1e9 if r[5] is None else r[5]) if max(r[5] if r[5] is not None else -1e9 for r in c) > 0 else (lambda r: r[6])
        want.add(max(c, key=by)[0])
    got = windows.indel_gap(spark.createDataFrame(rows, SCHEMA), 3, 64, "INFO_DP")
    assert {r.site_id for r in got.where("passed").collect()} == want and got.count() == len(rows)


def test_ties_have_one_order(spark):
    """Sites of one position come by their alleles, whatever the partitions."""
    rng = random.Random(2)
    rows = [(i, "x", rng.randint(1, 60), "A", f"C{i:03d}", rng.random(), rng.choice([0, 1])) for i in range(200)]
    order = sorted(rows, key=lambda r: (r[2], r[3], r[4]))
    want = sum(a[6] != b[6] for a, b in zip(order, order[1:], strict=False))
    for parts in (1, 5):
        df = spark.createDataFrame(rng.sample(rows, 200), SCHEMA).repartition(parts)
        for block in (7, 1000):
            assert windows.switches(df, "INFO_DP", block=block).first().n_switches == want
            assert windows.blocks(df, "INFO_DP", block=block).count() == want + 1
