"""Small sources meet their targets at the production block size, over one shard and many."""

import pytest

from lociframe.llm import mixing


def totals(spark, sizes, shard):
    """{source size: (target, taken)}; a document of 7 words or fewer for each part of a source."""
    rows = [(1000 * i + j, s, "w " * min(7, n - 7 * j)) for i, (s, n) in enumerate(sizes.items()) for j in range(-(-n // 7))]
    out = {}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), shard=shard).collect():
        assert r.taken <= mixing.REPEATS * r.size
        target, taken = out.get(r.source_size, (r.target, 0))
        out[r.source_size] = target, taken + r.taken
    return out


@pytest.mark.parametrize("shard", [4, mixing.SHARD])
def test_small_beside_hot(spark, shard):
    got = totals(spark, {"a": 10, "b": 70, "c": 150, None: 6000}, shard)
    assert [got[n] for n in (10, 70, 150)] == [(30, 30), (210, 210), (450, 450)]
    assert abs(got[6000][1] - got[6000][0]) < mixing.BLOCK


@pytest.mark.parametrize("shard", [2, mixing.SHARD])
def test_targets_between(spark, shard):
    got = totals(spark, {"a": 68, "b": 69, "c": 70, "d": 71, "e": 72, "f": 150, "g": 151, None: 131}, shard)
    assert all(abs(taken - target) < mixing.BLOCK for target, taken in got.values())
