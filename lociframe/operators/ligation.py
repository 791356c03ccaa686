"""Ligation of phased chunks: neighbouring chunks of a contig overlap, and a sample's phase goes on from one to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.operators.sequence import settled

KEY = ["CHROM", "POS", "REF", "ALT"]


def flipped(gt: Column) -> Column:
    """A phased diploid genotype with its two alleles exchanged; others stay."""
    a = F.split(gt, r"\|")
    return F.when((F.size(a) == 2) & ~gt.contains("/"), F.concat(F.get(a, F.lit(1)), F.lit("|"), F.get(a, F.lit(0)))).otherwise(gt)


def agreement(first: Column, second: Column) -> Column:
    """1 if two phased heterozygous genotypes of the same alleles have one phase, -1 if the other, 0 if they don't say."""
    a = F.split(first, r"\|")
    het = (F.size(a) == 2) & ~first.contains("/") & (F.get(a, F.lit(0)) != F.get(a, F.lit(1)))
    return F.when(~F.coalesce(het, F.lit(False)), 0).when(first == second, 1).when(second == flipped(first), -1).otherwise(0)


def chunk_bounds(rows: DataFrame) -> DataFrame:
    """CHROM, chunk, nxt, cut, start, stop: for every chunk and the next of its contig, where that begins, and the first position that is
    the next one's: of the sites that both have, ordered, the one in the middle. Chunks are a few for each contig."""
    w = Window.partitionBy("CHROM").orderBy("chunk")
    ends = rows.groupBy("CHROM", "chunk").agg(F.min("POS").alias("low"), F.max("POS").alias("high"))
    return ends.withColumns({"nxt": F.lead("chunk").over(w), "start": F.lead("low").over(w)}).where("nxt is not null").select("CHROM", "chunk", "nxt", "start", F.col("high").alias("stop"))


def ligated(rows: DataFrame, keep_unshared: bool = True) -> DataFrame:
    """Records of phased chunks as one call set: CHROM, chunk (a number, in order), POS, REF, ALT, samples and other columns; chunk goes.

    A chunk overlaps the next one of its contig only. For each pair and sample, the heterozygous phased genotypes of shared
    sites (equal REF and ALT) say whether the next chunk's phase is the other way round: more that differ than agree. A chunk's
    genotypes are exchanged if an odd number of the turns up to it are; each chunk has its samples in one order. Up to the
    middle of the shared sites records come from the earlier chunk, from there on from the later one. Records in an overlap
    that only one chunk has are kept where they are on its side, or dropped.
    """
    bounds = settled(chunk_bounds(rows))
    left = rows.join(bounds, ["CHROM", "chunk"]).where(F.col("POS") >= F.col("start"))
    right = rows.join(bounds.select("CHROM", F.col("nxt").alias("chunk"), F.col("chunk").alias("before"), "stop"), ["CHROM", "chunk"]).where(F.col("POS") <= F.col("stop"))
    both = left.select(*KEY, "chunk", "nxt", F.col("samples.GT").alias("g")).join(right.select(*KEY, F.col("before").alias("chunk"), F.col("samples.GT").alias("g2")), [*KEY, "chunk"])
    both = settled(both.select(*KEY, "chunk", "nxt", F.zip_with("g", "g2", agreement).alias("same")))

    votes = both.select("CHROM", "chunk", "nxt", F.posexplode("same").alias("s", "v")).groupBy("CHROM", "chunk", "nxt", "s").agg(F.sum("v").alias("v"))
    turns = votes.select("CHROM", F.col("nxt").alias("chunk"), "s", (F.col("v") < 0).cast("int").alias("turn"))
    w = Window.partitionBy("CHROM", "s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)  # a row for each chunk
    flips = turns.withColumn("flip", F.sum("turn").over(w) % 2 == 1)
    # a sample without a turn at some chunk can't be: every shared site has all samples; chunks without shared sites begin anew
    flips = flips.groupBy("CHROM", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "flip"))), lambda x: x["flip"]).alias("_flip"))

    rank = Window.partitionBy("CHROM", "chunk").orderBy("POS", "REF", "ALT")  # the shared sites of one overlap
    middle = both.select("CHROM", "chunk", "POS", F.row_number().over(rank).alias("i"), F.count("*").over(Window.partitionBy("CHROM", "chunk")).alias("n")).where("i = floor(n / 2) + 1").select("CHROM", "chunk", F.col("POS").alias("mid"))
    cuts = bounds.join(middle, ["CHROM", "chunk"], "left").select("CHROM", "chunk", "nxt", "start", "stop", F.coalesce("mid", "start").alias("cut"))
    own = cuts.select("CHROM", "chunk", F.col("cut").alias("_to"), F.col("start").alias("_over_from"))
    before = cuts.select("CHROM", F.col("nxt").alias("chunk"), F.col("cut").alias("_from"), F.col("stop").alias("_over_to"))
    t = rows.join(own, ["CHROM", "chunk"], "left").join(before, ["CHROM", "chunk"], "left").join(flips, ["CHROM", "chunk"], "left")
    t = t.where((F.col("_to").isNull() | (F.col("POS") < F.col("_to"))) & (F.col("_from").isNull() | (F.col("POS") >= F.col("_from"))))
    if not keep_unshared:
        shared = both.select(*KEY, F.lit(True).alias("_shared")).distinct()
        over = F.coalesce(F.col("POS") >= F.col("_over_from"), F.lit(False)) | F.coalesce(F.col("POS") <= F.col("_over_to"), F.lit(False))
        t = t.join(shared, KEY, "left").where(~over | F.col("_shared")).drop("_shared")
    turned = F.transform("samples", lambda s, i: F.when(F.get(F.col("_flip"), i), s.withField("GT", flipped(s["GT"]))).otherwise(s))
    t = t.withColumn("samples", F.when(F.col("_flip").isNull(), F.col("samples")).otherwise(turned))
    return t.select(*(c for c in rows.columns if c != "chunk"))
