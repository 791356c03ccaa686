"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A fingerprint is a sum over a text's paragraphs (its lines) of vectors hashed from them, so it does not depend on their
order, and a paragraph is inserted or deleted by adding or subtracting its vector:
- EXACT lanes: 32-bit hashes of the paragraph, summed modulo 2^32. They tell multisets of paragraphs apart. A text has 2^31
  lines at most, so that no sum goes beyond a long before it is reduced.
- NEAR lanes: +1 or -1 for each of the paragraph's three-word shingles by one hash bit a lane, summed modulo 2^16.
  The inner product of two texts' NEAR lanes estimates how many shingles they share, as long as no lane wraps: one
  shingle that makes up a text more than 32,767 times over leaves a likeness without meaning, if still from 0 to 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lociframe.llm.common import doc_id, keyed, materialise

EXACT, EXACT_BITS = 8, 32
NEAR, NEAR_BITS = 128, 16  # lanes: 64 for each of two hashes
PAIR = 0x0000000100000001  # bit 0 and bit 32: two lanes are counted in one long


def paragraphs(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per shingle of each paragraph: keys, para (on a paragraph's first row only), w1, w2, w3."""
    lines = rows.select(*keys, F.explode(F.split(F.col(text), "\n")).alias("para"))
    w = F.split(F.col("para"), "[\\x20\\x09-\\x0D]+")
    lines = lines.withColumn("w", w)
    zipped = F.arrays_zip(F.col("w").alias("w1"), F.slice("w", F.lit(2), F.size("w")).alias("w2"), F.slice("w", F.lit(3), F.size("w")).alias("w3"))
    return lines.select(*keys, "para", F.posexplode(zipped)).select(*keys, F.when(F.col("pos") == 0, F.col("para")).alias("para"), F.col("col.w1").alias("w1"), F.col("col.w2").alias("w2"), F.col("col.w3").alias("w3"))


def fingerprints(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """keys, exact (array of EXACT sums) and near (array of NEAR sums from -2^15 to 2^15 - 1), for rows unique in keys.

    If rows are dealt by the first key already, the sums need no shuffle.
    """
    shingles = paragraphs(rows, text, *keys)
    shingles = shingles.withColumns({"h1": F.xxhash64("w1", "w2", "w3"), "h2": F.xxhash64("w3", "w1", F.lit(1), "w2")})
    part = F.coalesce(F.col("para"), F.lit(""))
    exact = [F.when(F.col("para").isNotNull(), F.shiftrightunsigned(F.xxhash64(F.lit(i), part), 64 - EXACT_BITS)) for i in range(EXACT)]
    bits = [F.shiftrightunsigned(h, j).bitwiseAND(F.lit(PAIR)) for h in ("h1", "h2") for j in range(32)]
    sums = shingles.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(x).alias(f"x{i}") for i, x in enumerate(exact)), *(F.sum(b).alias(f"b{j}") for j, b in enumerate(bits)))
    size = 1 << NEAR_BITS
    centred = lambda x: F.pmod(x + size // 2, F.lit(size)) - size // 2
    ones = [x for j in range(len(bits)) for x in (F.col(f"b{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"b{j}", 32))]
    near = [centred(2 * x - F.col("n")).cast("smallint") for x in ones]
    return sums.select(*keys, F.array(*(F.pmod(F.col(f"x{i}"), F.lit(1 << EXACT_BITS)) for i in range(EXACT))).alias("exact"), F.array(*near).alias("near"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint (exact, near) of two multisets' union (sign 1), or of the first without the second (sign -1)."""
    size = 1 << NEAR_BITS
    near = F.zip_with(a["near"], b["near"], lambda x, y: (F.pmod(x.cast("int") + sign * y.cast("int") + size // 2, F.lit(size)) - size // 2).cast("smallint"))
    return F.struct(F.zip_with(a["exact"], b["exact"], lambda x, y: F.pmod(x + sign * y, F.lit(1 << EXACT_BITS))).alias("exact"), near.alias("near"))


def as_text(exact: str, near: str) -> Column:
    """Lower-case hexadecimal of all lanes."""
    lanes = F.concat(F.transform(exact, lambda x: F.lpad(F.hex(x), EXACT_BITS // 4, "0")), F.transform(near, lambda x: F.lpad(F.hex(x.cast("int").bitwiseAND(F.lit((1 << NEAR_BITS) - 1))), NEAR_BITS // 4, "0")))
    return F.lower(F.array_join(lanes, ""))


def likeness(a: str, b: str) -> Column:
    """Cosine of two NEAR vectors, from 0 to 1: an estimate of the share of shingles in common, 1 for equal vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda acc, v: acc + v)
    scale = F.sqrt(dot(a, a) * dot(b, b))
    cosine = F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def successors(ids: DataFrame) -> DataFrame:
    """ids (k, n; k unique) with next_k, the next smaller k (the largest for the smallest), and the k and n it is next of:
    prev_k, prev_n. Ids are sorted within ranges; only the ends of the ranges, as many as there are partitions, meet."""
    part = materialise(ids.repartitionByRange(F.desc("k")).withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy(F.desc("k"))
    ends = part.groupBy("part").agg(F.max("k").alias("first"), F.min("k").alias("last"), F.min_by("n", "k").alias("last_n"))
    line = Window.orderBy(F.desc("first"))
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.withColumns({"after": F.lead("first").over(line), "before": F.lag("last").over(line), "before_n": F.lag("last_n").over(line)})
    ends = ends.withColumns({"top": F.first("first").over(whole), "bottom": F.last("last").over(whole), "bottom_n": F.last("last_n").over(whole)})
    ends = ends.select("part", F.coalesce("after", "top").alias("after"), F.coalesce("before", "bottom").alias("before"), F.coalesce("before_n", "bottom_n").alias("before_n"))
    inner = part.withColumns({"next_k": F.lead("k").over(own), "prev_k": F.lag("k").over(own), "prev_n": F.lag("n").over(own)})
    return inner.join(ends, "part").select("k", F.coalesce("next_k", "after").alias("next_k"), F.coalesce("prev_k", "before").alias("prev_k"), F.coalesce("prev_n", "before_n").alias("prev_n"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many, or all, of the
    next document's text, by descending doc_id; after the smallest comes the largest, and a single document follows itself.
    A null text is an empty one: one empty paragraph. A null doc_id comes last. Rows that share a doc_id are one place in
    that order: their next document is that of the next other id, and where the next id has several texts, the least prefix
    and the least fingerprint stand for it. An empty table gives no rows. Other columns are ignored.
    """
    own = keyed(docs)
    ids = own.groupBy("k").agg(F.max(F.length("text").cast("long")).alias("n"))
    chain = materialise(successors(ids))
    linked = own.join(chain.withColumnRenamed("k", "k2"), F.col("k") == F.col("k2")).drop("k2")
    half = lambda n: F.floor(n / 2).cast("int")
    given = linked.groupBy("prev_k").agg(F.min(F.expr("substring(text, 1, cast(floor(prev_n / 2) as int))")).alias("given"))
    both = linked.join(given.withColumnRenamed("prev_k", "k2"), F.col("k") == F.col("k2")).drop("k2", "prev_k", "prev_n")
    both = both.withColumn("n", F.length("text")).withColumn("row", F.monotonically_increasing_id())
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - half(F.col("n"))), F.substring("given", F.lit(1), half(F.col("n"))))
    both = both.select("k", "row", "next_k", F.col("n").cast("long").alias("n_chars"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), edited.alias("body")))).alias("v"))
    both = both.select("k", "row", "next_k", "n_chars", F.col("v.which").alias("which"), F.col("v.body").alias("body"), F.when(F.col("v.which") == 1, F.sha2(F.col("v.body").cast("binary"), 256)).alias("sha"))
    prints = fingerprints(both, "body", "k", "row", "next_k", "n_chars", "which", "sha")
    two = materialise(prints.groupBy("k", "row", "next_k", "n_chars").agg(
        F.max("sha").alias("edited_sha256"), *(F.max(F.when(F.col("which") == w, F.col(c))).alias(f"{c}{w}") for w in (0, 1) for c in ("exact", "near"))))
    firsts = two.groupBy(F.col("k").alias("k2")).agg(F.min("near0").alias("near2"))
    out = two.join(firsts, F.col("next_k") == F.col("k2"))
    return out.select(doc_id(), "n_chars", "edited_sha256", as_text("exact0", "near0").alias("fingerprint"), as_text("exact1", "near1").alias("edited_fingerprint"), likeness("near0", "near1").alias("near_edited"), likeness("near0", "near2").alias("near_next"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
