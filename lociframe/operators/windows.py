"""Operators over neighbouring sites of a contig.

No window takes a contig's sites in one task. Frames of a bounded distance run within blocks of positions, to which the
sites just beyond their edges are copied. Running values and neighbours are taken within blocks too, and one row a block
carries what came before: a contig has as many such rows as blocks, however many sites it has.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 14  # positions in a block: the largest human contig has 15,200 of them


def with_halo(sites: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """Sites with _b, a block that has them within `distance` of its positions, and _own, whether they lie in it."""
    block = max(block, distance)
    at = F.col("POS")
    near = F.sequence(F.floor((at - distance) / block), F.floor((at + distance) / block))
    return sites.withColumn("_b", F.explode(near)).withColumn("_own", F.col("_b") == F.floor(at / block))


def place(sites: DataFrame, *but: str) -> list[str]:
    """The order of sites: by POS, then by the alleles and site_id where there is one, so that sites of one position come in one order
    always, in every window of an operator."""
    return ["POS", *(c for c in ("REF", "ALT", "site_id") if c in sites.columns and c not in but)]


def running(sites: DataFrame, name: str, value: Column, how: Callable[[Column], Column], inclusive: bool, by: tuple[str, ...] = ("CHROM",), block: int = BLOCK, order: list | None = None) -> DataFrame:
    """Column `name`: how (F.max or F.sum) over value of the sites up to each one by order (see place), itself included or not."""
    order = order or place(sites, *by)
    t = sites.withColumn("_v", value).withColumn("_b", F.floor(F.col("POS") / block))
    inner = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    carried = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = t.groupBy(*by, "_b").agg(how(F.col("_v")).alias("_t")).withColumn("_c", how(F.col("_t")).over(carried)).drop("_t")
    joined = t.withColumn("_i", how(F.col("_v")).over(inner)).join(per, [*by, "_b"])
    both = F.greatest("_i", "_c") if how is F.max else F.coalesce(F.col("_i") + F.col("_c"), "_i", "_c")
    return joined.withColumn(name, both).drop("_v", "_b", "_i", "_c")


def neighbour(sites: DataFrame, name: str, value: Column, step: int, by: tuple[str, ...] = ("CHROM",), block: int = BLOCK) -> DataFrame:
    """Column `name`: value at the next site (step 1) or the one before (step -1) by POS and alleles; null without one."""
    order = place(sites, *by)
    t = sites.withColumn("_v", value).withColumn("_b", F.floor(F.col("POS") / block))
    inner, carried = Window.partitionBy(*by, "_b").orderBy(*order), Window.partitionBy(*by).orderBy("_b")
    edge = F.min_by("_v", F.struct(*order)) if step > 0 else F.max_by("_v", F.struct(*order))
    per = t.groupBy(*by, "_b").agg(edge.alias("_t")).withColumn("_c", F.lead("_t").over(carried) if step > 0 else F.lag("_t").over(carried)).drop("_t")
    moved = (F.lead if step > 0 else F.lag)(F.struct("_v")).over(inner)
    joined = t.withColumn("_i", moved).join(per, [*by, "_b"])
    return joined.withColumn(name, F.when(F.col("_i").isNull(), F.col("_c")).otherwise(F.col("_i._v"))).drop("_v", "_b", "_i", "_c")


def count_near(sites: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """Sites of the contig within `distance` positions on either side, the site itself included."""
    w = Window.partitionBy("CHROM", "_b").orderBy("POS").rangeBetween(-distance, distance)
    return with_halo(sites, distance, block).withColumn("n_near", F.count("*").over(w)).where("_own").drop("_b", "_own")


def thin(sites: DataFrame, width: int, keep: int, *order) -> DataFrame:
    """At most `keep` sites of every stretch of `width` positions, the first by order."""
    w = Window.partitionBy("CHROM", F.floor(F.col("POS") / width)).orderBy(*order)
    return sites.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def islands(sites: DataFrame, gap: int, block: int = BLOCK) -> DataFrame:
    """island: number of the chain a site belongs to; a chain goes on while POS <= gap + end of the furthest REF before."""
    t = running(sites, "_reach", F.col("POS") + F.length("REF") - 1, F.max, False, block=block)
    new = (F.col("_reach").isNull() | (F.col("POS") > F.col("_reach") + gap)).cast("int")
    # of equal sites the one that begins a chain comes first, so that they are all in it
    return running(t.withColumn("_new", new), "island", F.col("_new"), F.sum, True, block=block, order=["POS", F.desc("_new")]).drop("_reach", "_new")


def indel_gap(sites: DataFrame, gap: int, block: int = BLOCK, count: str | None = None) -> DataFrame:
    """Indels with passed: of every chain the one with the highest QUAL passes, or where no QUAL is above 0 and `count` names a
    column of allele counts, the one with the largest; the first of equals. Chains follow islands."""
    indels = islands(sites.where(F.length("REF") != F.length("ALT")), gap, block)
    chain = Window.partitionBy("CHROM", "island")
    if count is None:
        best = chain.orderBy(F.desc_nulls_last("QUAL"), *place(sites))
        return indels.withColumn("passed", F.row_number().over(best) == 1)
    by = F.when(F.max("QUAL").over(chain) > 0, F.coalesce(F.col("QUAL").cast("double"), F.lit(float("-inf")))).otherwise(F.coalesce(F.col(count).cast("double"), F.lit(-1.0)))
    indels = indels.withColumn("_by", by)
    return indels.withColumn("passed", F.row_number().over(chain.orderBy(F.desc("_by"), *place(sites))) == 1).drop("_by")


def snp_gap(sites: DataFrame, gap: int, block: int = 1024) -> DataFrame:
    """SNPs with passed: false if an indel's REF lies within `gap` positions, an indel at the SNP's own position aside.

    Indels meet the SNPs of a block as one array, which holds the indels that reach into the block's positions.
    """
    is_indel = F.length("REF") != F.length("ALT")
    end = F.col("POS") + F.length("REF") - 1
    reach = F.explode(F.sequence(F.floor((F.col("POS") - gap) / block), F.floor((end + gap) / block)))
    near = sites.where(is_indel).select("CHROM", reach.alias("_b"), F.struct(F.col("POS").alias("at"), end.alias("end")).alias("_x")).groupBy("CHROM", "_b").agg(F.collect_list("_x").alias("_x"))
    snps = sites.where(~is_indel).withColumn("_b", F.floor(F.col("POS") / block)).join(near, ["CHROM", "_b"], "left")
    at = F.col("POS")
    hit = F.exists("_x", lambda v: ((v["at"] < at) & (at <= v["end"] + gap)) | ((v["at"] > at) & (v["at"] <= at + gap)))
    return snps.withColumn("passed", ~F.coalesce(hit, F.lit(False))).drop("_b", "_x")


def without_overlaps(sites: DataFrame, deletions_late: bool = False, block: int = BLOCK) -> DataFrame:
    """Sites whose REF overlaps no other site's: a site that begins within the reach of those before drops with its
    predecessor. With deletions_late a deletion begins one base later, as its first base is its neighbour's."""
    begin = F.col("POS") + F.when(F.length("REF") > F.length("ALT"), 1).otherwise(0) if deletions_late else F.col("POS")
    t = running(sites, "_reach", F.col("POS") + F.length("REF") - 1, F.max, False, block=block)
    t = neighbour(t.withColumn("_hit", F.coalesce(begin <= F.col("_reach"), F.lit(False))), "_next", F.col("_hit"), 1, block=block)
    return t.where(~F.col("_hit") & ~F.coalesce("_next", F.lit(False))).drop("_reach", "_hit", "_next")


def without_lower_overlaps(sites: DataFrame, value: str = "QUAL", missing: str = "0", depth: str = "INFO_DP", mark: str | None = None, width: int = 1024, block: int = BLOCK) -> DataFrame:
    """Sites left when those of the lowest value go, one after another, until no REFs overlap; or with `mark`, all of them with that
    column, whether they go. Of equal values the site later by position and alleles goes first.

    A site goes if it overlaps any that comes after it in that order: those are all still there at its turn, and where there is none, its
    neighbours have gone before it. So nothing but a site's own neighbours decides, and no chain of sites meets in one task. A missing
    value counts as 0, or for missing "DP" as the chain's largest value in proportion to the depths of the two sites.
    """
    from lociframe.operators.sequence import settled

    end = F.col("POS") + F.length("REF") - 1
    t = sites.withColumn("_value", F.col(value).cast("double"))
    if missing == "DP":
        t = islands(t, 0, block)
        top = t.where(f"_value is not null and {depth} > 0").groupBy("CHROM", "island").agg(F.max_by(F.struct(F.col("_value").alias("v"), F.col(depth).alias("d")), F.col("_value")).alias("_top"))
        t = t.join(top, ["CHROM", "island"], "left").withColumn("_value", F.coalesce("_value", F.col("_top.v") * F.col(depth) / F.col("_top.d"))).drop("_top", "island")
    elif missing != "0":
        raise ValueError(f"no such value for missing ones: {missing}")
    t = settled(t.withColumns({"_value": F.coalesce("_value", F.lit(0.0)), "_id": F.monotonically_increasing_id()}))
    cut = F.explode(F.sequence(F.floor(F.col("POS") / width), F.floor(end / width)))
    order = [c for c in place(sites) if c != "POS"]
    binned = t.select("CHROM", F.col("POS").cast("long").alias("b"), end.cast("long").alias("e"), "_value", "_id", *(F.col(c).cast("string").alias(f"_o{i}") for i, c in enumerate(order)), cut.alias("_b"))

    def losers(key: tuple, table: pa.Table) -> pa.Table:
        names = [f"_o{i}" for i in range(len(order))]
        table = table.sort_by([("_value", "descending"), ("b", "ascending"), *((n, "ascending") for n in names), ("_id", "ascending")])
        starts, ends, gone = [], [], []  # what the sites before cover, as stretches apart from each other
        for b, e, i in zip(table.column("b").to_pylist(), table.column("e").to_pylist(), table.column("_id").to_pylist(), strict=True):
            lo, hi = bisect_left(ends, b), bisect_right(starts, e)
            if lo < hi:
                gone.append(i)
                b, e = min(b, starts[lo]), max(e, ends[hi - 1])
            starts[lo:hi], ends[lo:hi] = [b], [e]
        return pa.table({"_gone": pa.array(gone, pa.int64())})

    lost = binned.groupBy("CHROM", "_b").applyInArrow(losers, "_gone long").distinct()
    out = t.join(lost, F.col("_id") == F.col("_gone"), "left").drop("_id", "_value")
    return out.where("_gone is null").drop("_gone") if mark is None else out.withColumn(mark, F.col("_gone").isNotNull()).drop("_gone")


def same_position(sites: DataFrame) -> DataFrame:
    """Sites that share contig and POS with another, whatever their alleles."""
    several = sites.groupBy("CHROM", "POS").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return sites.join(several, ["CHROM", "POS"], "left_semi")


def first_of_duplicates(sites: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of every key. max_by-style partial aggregation keeps a key with many rows from meeting in one task."""
    others = [c for c in sites.columns if c not in keys]
    kept = sites.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in others if c != order])).alias("_r"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in sites.columns])


def blocks(tidy: DataFrame, value: str, *by: str, block: int = BLOCK) -> DataFrame:
    """Runs of neighbouring sites with the same value in by + CHROM: first and last POS and sites of each."""
    keys = (*by, "CHROM")
    t = neighbour(tidy.select(*dict.fromkeys([*keys, *place(tidy), value])), "_last", F.struct(F.col(value).alias("x")), -1, keys, block)
    changed = (F.col("_last").isNull() | (F.col("_last.x") != F.col(value))).cast("int")
    run = running(t, "_run", changed, F.sum, True, keys, block)
    return run.groupBy(*keys, "_run", value).agg(F.min("POS").alias("begin"), F.max("POS").alias("end"), F.count("*").alias("n")).drop("_run")


def switches(tidy: DataFrame, value: str, *by: str, block: int = BLOCK) -> DataFrame:
    """How often value differs from the site before, per by."""
    t = neighbour(tidy.select(*dict.fromkeys([*by, "CHROM", *place(tidy), value])), "_last", F.col(value), -1, (*by, "CHROM"), block)
    return t.where(F.col("_last").isNotNull()).groupBy(*by).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("_last") != F.col(value)).alias("n_switches"))


def phase_switches(tidy: DataFrame, by: tuple[str, ...] = ("sample_id",), block: int = BLOCK) -> DataFrame:
    """Of neighbouring phased heterozygous genotypes, per by: pairs, and those whose phase is the other way round."""
    a = F.split("GT", r"\|")
    het = tidy.where(F.col("GT").contains("|") & (F.size(a) == 2)).where((F.get(a, F.lit(0)) != F.get(a, F.lit(1))) & ~F.array_contains(a, "."))
    first = F.get(a, F.lit(0)).cast("int") < F.get(a, F.lit(1)).cast("int")
    return switches(het.withColumn("_first", first), "_first", *by, block=block)


def prune_sliding(sites: DataFrame, width: int, keep: int, rule: str = "1st", frequency: str = "AF", seed: int = 0, block: int = BLOCK) -> DataFrame:
    """At most `keep` sites in any stretch of `width` positions, taken as it slides from site to site: where one is too many,
    the latest goes (1st), the one of the lowest frequency, the later of equals (maxAF), or one by a hash of its place (rand).

    Sites more than `width` apart don't see each other, so a contig falls into chains, each pruned by itself in one task:
    the width should be below the gaps that a call set has here and there.
    """
    if rule not in ("1st", "maxAF", "rand"):
        raise ValueError(f"no such rule: {rule}")
    value = F.col(frequency).cast("double") if rule == "maxAF" else F.xxhash64(F.lit(seed), "CHROM", "POS").cast("double")
    rows = sites.withColumn("_f", F.coalesce(value, F.lit(float("-inf"))))
    before = running(rows, "_last", F.col("POS"), F.max, False, block=block)
    chains = running(before, "_chain", (F.col("_last").isNull() | (F.col("POS") - F.col("_last") >= width)).cast("int"), F.sum, True, block=block).drop("_last")

    def prune(table: pa.Table) -> pa.Table:
        table = table.sort_by("POS")
        at, f = table.column("POS").to_numpy(), table.column("_f").to_numpy()
        kept, window = np.ones(len(at), bool), []
        for i in range(len(at)):
            window = [x for x in window if at[i] - at[x] < width] + [i]
            if len(window) > keep:
                gone = window[-1] if rule == "1st" else min(reversed(window), key=lambda x: f[x])
                window.remove(gone)
                kept[gone] = False
        return table.filter(pa.array(kept))

    return chains.groupBy("CHROM", "_chain").applyInArrow(prune, chains.schema).drop("_chain", "_f")
