"""Mixing sources to target weights, in DataFrame functions only.

The words of each source, in an order of its documents, are cut into blocks of at most BLOCK words whose lengths differ by
one at most. A source gets the slots that its target needs at its own mean block length, rounded up or down by one draw of
the source. Every output shard of SHARD slots draws how many of its slots each source gets: a multinomial draw under the condition
that the totals are met (see drawn_counts). The slots of a source are numbered through its shards; slot j takes the block that a
pseudorandom permutation of the source's block indices, a new one in each pass through the source, gives for j. Blocks join
slots by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.llm.common import NO_ID, doc_id, keyed, materialise, n_parts

WEIGHTS = (5, 2, 1)
REPEATS = 3  # times a source, and so a document, is taken at most
BLOCK = 64  # words in a block, at most
SHARD = 16384  # slots in an output shard; the last has what is left
DRAWN = 512  # sources whose counts a shard draws; beyond, one permutation deals all slots, which gives counts of the same law
STRETCH = 65536  # slots of a source that a task makes at once
BUCKET = 10_000  # documents whose sizes are summed up in order in one group, about
ROUNDS, STEPS = 4, 16  # of the permutation; see permuted


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sid, source, source_size, target for the sources of sizes (source, size): a row per source, null last.

    Sources by code point weigh weights[0], weights[1], ..., repeating, and share the sum of all sizes. A target stops at
    `repeats` times its source's size and the excess is shared anew. In the order of that limit per weight, all sources
    before some place stop at their limits and all from there on get a common multiple of their weights.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    per = per.withColumn("sid", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", (repeats * F.col("source_size")).cast("double"))
    rank = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    whole = rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"total": F.sum("source_size").over(whole), "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    per = per.withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
    per = per.withColumn("share", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(whole)["level"])
    return per.select("sid", "source", "source_size", "total", F.least("cap", F.coalesce(F.col("share") * F.col("weight"), "cap")).alias("target"))


def offsets(rows: DataFrame, buckets: int) -> DataFrame:
    """rows (sid, k, size) with `start`, the words of the source before the document, in the order of a hash of k.

    Sums run within buckets of about BUCKET documents, then over the buckets of a source.
    """
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)))
    inner = Window.partitionBy("sid", "bucket").orderBy("k", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("in_bucket")).withColumn("base", F.coalesce(F.sum("in_bucket").over(over), F.lit(0))).select(F.col("sid").alias("s2"), F.col("bucket").alias("b2"), "base")
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return rows.join(base, (F.col("sid") == F.col("s2")) & (F.col("bucket") == F.col("b2"))).withColumn("start", F.col("base") + F.col("inner")).drop("inner", "base", "s2", "b2", "bucket")


def permuted(index: Column, n: Column, *seed: Column) -> Column:
    """A permutation of 0 .. n - 1, chosen by the seed, at index.

    A Feistel network over pairs (left < a, right < b) with a = ceil(sqrt(n)), b = ceil(n / a) permutes 0 .. a b - 1, of
    which fewer than a are n or more; from such a value the network is applied again. Below 256 values STEPS times are
    always enough; above, missing them has a probability under 1e-19.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def network(x: Column) -> Column:
        def turn(pair: Column, r: Column) -> Column:
            left = (pair["left"] + F.pmod(F.xxhash64(r, pair["right"], *seed), a)) % a
            right = (pair["right"] + F.pmod(F.xxhash64(-1 - r, left, *seed), b)) % b
            return F.struct(left.alias("left"), right.alias("right"))

        start = F.struct(F.floor(x / b).alias("left"), (x % b).alias("right"))
        return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn, lambda pair: pair["left"] * b + pair["right"])

    return F.aggregate(F.sequence(F.lit(2), F.lit(STEPS)), _once(network, index), lambda x, _: F.when(x < n, x).otherwise(_once(network, x)))


def _once(network, x: Column) -> Column:
    return network(x).cast("long")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def drawn_counts(s: Column, at: Column, n_shards: Column, shard: int) -> Column:
    """What shard `at` gets of each source: s, an array of structs with n, the slots of a source in all shards, comes back with the
    slots in this shard as n and those in the shards before as `before`.

    The range of shards is halved until this shard is left. At each halving the left half draws its slots of each source, in order,
    from those not drawn yet: the normal draw with the mean and variance of drawing without replacement, rounded, and kept to
    what leaves both halves full. A draw depends on range and source only, so all shards of a range agree on it, and counts
    add up to the shards' sizes and to the sources' totals exactly.
    """

    def draw(acc: Column, x: Column, lo: Column, hi: Column) -> Column:
        unit = lambda salt: (F.pmod(F.xxhash64(F.lit(salt), lo, hi, x["sid"]), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
        z = F.sqrt(-2 * F.log(unit("radius"))) * F.cos(F.lit(6.283185307179586) * unit("angle"))
        share, left = x["n"] / acc["total"], acc["left"]
        spread = F.sqrt(left * share * (1 - share) * (acc["total"] - left) / F.greatest(acc["total"] - 1, F.lit(1)))
        v = F.round(left * share + spread * z).cast("long")
        kept = F.least(x["n"], left, F.greatest(F.lit(0).cast("long"), left - (acc["total"] - x["n"]), v))
        return F.when(acc["total"] > 0, kept).otherwise(F.lit(0).cast("long"))

    def halve(state: Column) -> Column:
        lo, hi = state["lo"], state["hi"]
        mid = F.shiftright(lo + hi, 1)
        total = F.aggregate(state["s"], F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
        start = F.struct(total.alias("total"), ((mid - lo) * shard).alias("left"), F.array().cast("array<long>").alias("out"))
        one = lambda acc, x: _let(draw(acc, x, lo, hi), lambda v: F.struct((acc["total"] - x["n"]).alias("total"), (acc["left"] - v).alias("left"), F.concat(acc["out"], F.array(v)).alias("out")))
        drawn = F.aggregate(state["s"], start, one, lambda acc: acc["out"])
        here = at < mid
        side = lambda x, v: x.withField("n", F.when(here, v).otherwise(x["n"] - v)).withField("before", x["before"] + F.when(here, F.lit(0).cast("long")).otherwise(v))
        return F.struct(F.when(here, lo).otherwise(mid).alias("lo"), F.when(here, mid).otherwise(hi).alias("hi"), F.zip_with(state["s"], drawn, side).alias("s"))

    whole = F.struct(F.lit(0).cast("long").alias("lo"), n_shards.alias("hi"), s.alias("s"))
    depth = F.greatest(F.lit(1), F.ceil(F.log2(n_shards.cast("double"))).cast("int") + 1)
    return F.aggregate(F.sequence(F.lit(1), depth), whole, lambda state, _: F.when(state["hi"] - state["lo"] > 1, halve(state)).otherwise(state), lambda state: state["s"])


def slots(sources: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(sid, source_size, slot, block, shard, place): what lies at each place of every shard. slot numbers a source's own.

    A shard of the drawn counts is a row with an array over the sources until its slots are made, evenly over all tasks.
    """
    s = sources.where("source_size > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / block))
    draw = F.pmod(F.xxhash64(F.lit("source"), "sid"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    s = s.withColumn("n", F.least(F.floor(F.col("target") * F.col("n_blocks") / F.col("source_size") + draw), REPEATS * F.col("n_blocks"))).where("n > 0")
    made = _drawn(s, shard) if s.count() <= DRAWN else _permuted(s, shard)
    taken = permuted(F.col("slot") % F.col("n_blocks"), F.col("n_blocks"), F.col("sid"), F.floor(F.col("slot") / F.col("n_blocks")))
    return made.select("sid", "source_size", "slot", taken.alias("block"), "shard", "place")


def _drawn(s: DataFrame, shard: int) -> DataFrame:
    """Slots by counts that each shard draws."""
    long = lambda c: F.col(c).cast("long").alias(c)
    parts, zero = n_parts(s.sparkSession), F.lit(0).cast("long")
    one = s.agg(F.array_sort(F.collect_list(F.struct("sid", long("source_size"), long("n_blocks"), long("n"), zero.alias("before")))).alias("s"), F.sum("n").cast("long").alias("n_all")).where("n_all > 0")
    one = one.withColumn("n_shards", F.ceil(F.col("n_all") / shard).cast("long")).withColumn("many", F.greatest(F.lit(1), F.ceil(F.col("n_shards") / (8 * parts))).cast("long"))
    rows = one.withColumn("from", F.explode(F.sequence(zero, F.col("n_shards") - 1, F.col("many")))).repartition(parts, "from")
    rows = rows.select("s", "n_all", "n_shards", F.explode(F.sequence("from", F.least(F.col("from") + F.col("many"), F.col("n_shards")) - 1)).alias("shard"))
    start = F.struct(zero.alias("at"), F.array().cast("array<long>").alias("out"))
    offsets = lambda counts: F.aggregate(counts, start, lambda acc, x: F.struct((acc["at"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    counts = _let(drawn_counts(F.col("s"), F.col("shard"), F.col("n_shards"), shard), lambda c: F.zip_with(c, offsets(c), lambda x, o: x.withField("offset", o)))
    size = F.least(F.lit(shard).cast("long"), F.col("n_all") - F.col("shard") * shard)
    rows = rows.select("shard", size.alias("size"), F.inline(counts)).where("n > 0")
    rows = rows.select("sid", "source_size", "n_blocks", "shard", "size", "before", "offset", F.explode(F.sequence(zero, F.col("n") - 1)).alias("j"))
    place = permuted(F.col("offset") + F.col("j"), F.col("size"), F.lit("places"), F.col("shard"))
    return rows.select("sid", "source_size", "n_blocks", (F.col("before") + F.col("j")).alias("slot"), "shard", place.alias("place"))


def _permuted(s: DataFrame, shard: int) -> DataFrame:
    """Slots of very many sources: numbered through all of them, and dealt to shards and places by one permutation."""
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("n_all", F.sum("n").over(whole))
    s = s.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STRETCH).cast("long"))))
    s = s.repartition(n_parts(s.sparkSession), "sid", "from")  # slots are made evenly over all tasks
    s = s.select("sid", "source_size", "n_blocks", "base", "n_all", F.explode(F.sequence("from", F.least(F.col("from") + STRETCH, F.col("n")) - 1)).alias("slot"))
    at = permuted(F.col("base") + F.col("slot"), F.col("n_all"), F.lit("shards"))
    return s.withColumn("at", at).select("sid", "source_size", "n_blocks", "slot", F.floor(F.col("at") / shard).alias("shard"), (F.col("at") % shard).alias("place"))


def blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(sid, row, block, at, n): the words at .. at + n - 1 of a document lie in a block; docs: sid, source_size, row, start,
    size. The first blocks of a source are one word longer than its others where its size isn't a multiple."""
    docs = docs.where("size > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / block))
    docs = docs.withColumn("short", F.floor(F.col("source_size") / F.col("n_blocks"))).withColumn("n_long", F.col("source_size") - F.col("short") * F.col("n_blocks"))
    in_long = F.col("n_long") * (F.col("short") + 1)
    block_of = lambda w: F.when(w < in_long, F.floor(w / (F.col("short") + 1))).otherwise(F.col("n_long") + F.floor((w - in_long) / F.col("short")))
    start_of = lambda b: b * F.col("short") + F.least(b, F.col("n_long"))
    parts = docs.withColumn("block", F.explode(F.sequence(block_of(F.col("start")), block_of(F.col("start") + F.col("size") - 1))))
    end = F.least(F.col("start") + F.col("size"), start_of(F.col("block") + 1))
    begin = F.greatest(F.col("start"), start_of(F.col("block")))
    return parts.select("sid", "row", "block", (begin - F.col("start")).alias("at"), (end - begin).alias("n"))


WORD = "[^\\x20\\x09-\\x0D]+"


def _dealt(rows: DataFrame, block: int, shard: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (k, source, size, row; materialised) with source_size and target; the pieces of documents in blocks; the slots."""
    sources = materialise(targets(rows))
    named = rows.join(sources.select("sid", F.col("source").alias("source2"), "source_size", "target"), F.col("source").eqNullSafe(F.col("source2"))).drop("source", "source2")
    buckets = max(1, rows.count() // BUCKET)
    placed = materialise(offsets(named.select("sid", "source_size", "k", "size", "row"), buckets))
    # The planner takes exploded sides for as small as what they are made from, and would broadcast them.
    return named, blocks(placed, block).hint("merge"), slots(sources, block, shard)


def _taken(rows: DataFrame, block: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """rows with source_size and target; and (row, block, times, at, n) of the blocks the mix takes: words at .. at + n - 1
    of the row's document."""
    named, parts, dealt = _dealt(rows, block, shard)
    return named, parts.join(dealt.groupBy("sid", "block").agg(F.count("*").alias("times")), ["sid", "block"])


def shards(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix as output shards: shard, place, doc_id, at, n: words at .. at + n - 1 of a document at a place of a shard.

    A block that spans several documents has a row for each, in the order of at. See mix for nulls, ties and empty tables.
    """
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    rows = materialise(keyed(docs, "source").select("k", "source", words.alias("size")).withColumn("row", F.monotonically_increasing_id()))
    _, parts, dealt = _dealt(rows, block, shard)
    return parts.join(dealt, ["sid", "block"]).join(rows.select("row", "k"), "row").select("shard", "place", doc_id(), "at", "n")


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """One row per row of documents: doc_id, size, source_size, target, taken.

    size counts words [^\\x20\\x09-\\x0D]+ (null text: 0). taken is how many of the document's words the mix takes, repeats
    counted, at most REPEATS times size. A null source is a source of its own; a source without words has target 0. Rows that
    share a doc_id are documents each. An empty table, or one without words, takes nothing. Other columns are ignored.
    A source gets less than one slot more or fewer than its target needs. A rerun gives the same result: what is drawn depends on
    source and place only. Equal rows are interchangeable.
    """
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    rows = materialise(keyed(docs, "source").select("k", "source", words.alias("size")).withColumn("row", F.monotonically_increasing_id()))
    named, parts = _taken(rows, block, shard)
    taken = parts.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    return named.hint("merge").join(taken, "row", "left").select(doc_id(), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix itself, as documents: the columns of docs, text holding what the mix takes of a document.

    That is the document's taken blocks in order, once for every pass through the source, a line break between passes. A
    document taken whole in one pass keeps its text as it is. Documents of which nothing is taken have no row. See mix for
    nulls, ties and empty tables.
    """
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    kept = materialise(docs.withColumns({"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__size": F.coalesce(words, F.lit(0)), "__row": F.monotonically_increasing_id()}))
    _, parts = _taken(kept.select(F.col("__k").alias("k"), "source", F.col("__size").alias("size"), F.col("__row").alias("row")), block, shard)
    lists = parts.groupBy(F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("at", "n", "times"))).alias("__parts"))
    tokens = F.regexp_extract_all("text", F.lit(WORD + "[\\x20\\x09-\\x0D]*"), F.lit(0))
    one = lambda p: F.array_join(F.transform(F.filter("__parts", lambda x: x["times"] >= p), lambda x: F.array_join(F.slice("__tokens", (x["at"] + 1).cast("int"), x["n"].cast("int")), "")), "")
    passes = F.filter(F.array(*(one(p) for p in range(1, REPEATS + 1))), lambda x: x != "")
    whole = F.forall("__parts", lambda x: x["times"] == 1) & (F.aggregate("__parts", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]) == F.col("__size"))
    text = F.when(whole, F.col("text")).otherwise(F.array_join(passes, "\n"))
    out = kept.hint("merge").join(lists, "__row").withColumn("__tokens", tokens).withColumn("text", text)
    return out.select(*docs.columns)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
