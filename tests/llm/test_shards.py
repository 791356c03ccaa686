"""Shards of the mix: whole, of the right size, with drawn source counts that meet the totals."""

from collections import Counter

from pyspark.sql import functions as F

from lociframe.llm import mixing


def test_shards(spark):
    docs = spark.createDataFrame([(i, "w " * (3 + i * 7 % 40), "abc"[i % 3] if i % 10 else None) for i in range(300)], "doc_id long, text string, source string")
    got = mixing.shards(docs, block=8, shard=100).collect()
    places = Counter(r.shard for r in {(r.shard, r.place): r for r in got}.values())
    last = max(places)
    assert set(places) == set(range(last + 1)) and all(places[s] == 100 for s in range(last)) and 0 < places[last] <= 100
    taken = Counter()
    for r in got:
        taken[r.doc_id] += r.n
    assert taken == Counter({r.doc_id: r.taken for r in mixing.mix(docs, block=8, shard=100).collect() if r.taken})


def test_counts_are_drawn(spark):
    """Counts of a source scatter over shards as in sampling without replacement, neither evenly nor in stretches."""
    sources = spark.createDataFrame([(0, "a", 80_000, 80_000.0), (1, "b", 240_000, 240_000.0)], "sid long, source string, source_size long, target double")
    slots = mixing.slots(sources, block=8, shard=1000)
    per = [r["n"] for r in slots.groupBy("shard").agg(F.count_if(F.col("sid") == 0).alias("n")).collect()]
    assert sum(per) == 10_000 and len(per) == 40
    spread = sum((x - 250) ** 2 for x in per) / 40
    assert 0.4 * 187.5 * 0.975 < spread < 2 * 187.5  # hypergeometric: 1000 * 1/4 * 3/4 * (1 - 1000/40000)
    assert slots.select("shard", "place").distinct().count() == 40_000


def test_counts_meet_shards_and_totals(spark):
    """Drawn counts fill every shard, add up to the totals, and number a source's slots through; a source of one slot is somewhere."""
    sizes = {0: 1, 1: 7, 2: 400, 3: 12_345, 4: 3, 5: 2_000}
    sources = spark.createDataFrame([(i, str(i), 8 * n, 8.0 * n) for i, n in sizes.items()], "sid long, source string, source_size long, target double")
    rows = mixing.slots(sources, block=8, shard=100).collect()
    total = sum(sizes.values())
    assert Counter(r.sid for r in rows) == sizes and {(r.shard, r.place) for r in rows} == {divmod(i, 100) for i in range(total)} and len(rows) == total
    for i, n in sizes.items():
        assert sorted(r.slot for r in rows if r.sid == i) == list(range(n)) and {r.block for r in rows if r.sid == i} == set(range(n))
        own = sorted((r.slot, r.shard) for r in rows if r.sid == i)
        assert [s for _, s in own] == sorted(s for _, s in own)


def test_very_many_sources(spark, monkeypatch):
    """Beyond DRAWN sources one permutation deals the slots: the same totals, whole shards."""
    docs = spark.createDataFrame([(i, "w " * (3 + i * 7 % 40), "abc"[i % 3]) for i in range(90)], "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, block=8, shard=20).collect()}
    monkeypatch.setattr(mixing, "DRAWN", 2)
    assert {r.doc_id: r.taken for r in mixing.mix(docs, block=8, shard=20).collect()} == taken
    places = Counter(s for s, _ in {(r.shard, r.place) for r in mixing.shards(docs, block=8, shard=20).collect()})
    last = max(places)
    assert set(places) == set(range(last + 1)) and all(places[s] == 20 for s in range(last))
