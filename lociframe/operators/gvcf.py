"""Merging of call sets with blocks of reference calls: records whose INFO_END says how far they go."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lociframe.operators import alleles as L
from lociframe.operators.sequence import filled_from_reference, settled

BIN = 1024  # positions swept in one task: what it holds is their records, of all sets
INFO_RULES = {"INFO_QS": "sum", "INFO_MinDP": "min", "INFO_IDV": "max", "INFO_IMF": "max", "INFO_DP": "sum"}
MISSING_RULES = {"PL": "max", "AD": 0}


def swept(rows: DataFrame, width: int = BIN) -> DataFrame:
    """CHROM, POS, LAST, r: stretches over which the same records hold, with these. rows: CHROM, POS, LAST, block, r.i, r.

    Blocks are cut wherever any set's block or other record begins or ends; a record that is no block holds at its position only, and
    there its set's blocks don't. Records are repeated once for each bin of positions they touch, and stretches that go on over the edge of
    a bin are put together again by their places alone.
    """
    cut = F.explode(F.sequence(F.floor(F.col("POS") / width), F.floor((F.col("LAST") + 1) / width)))  # its end is seen where it cuts
    kind = StructType([StructField("CHROM", rows.schema["CHROM"].dataType), *StructType.fromDDL("POS long, LAST long, goes_on boolean").fields, StructField("r", StructType.fromDDL("r array<int>")[0].dataType)])
    kind["r"].dataType.elementType = rows.schema["r"].dataType

    def sweep(key: tuple, table: pa.Table) -> pa.Table:
        low, high = key[1].as_py() * width, (key[1].as_py() + 1) * width - 1
        begin, end = table.column("POS").to_numpy(), table.column("LAST").to_numpy()
        edges = np.unique(np.concatenate([begin, end + 1]))
        edges = edges[(edges > low) & (edges <= high)]
        firm = bool(((begin == low) | (end + 1 == low)).any())
        left, right = np.concatenate([[low], edges]), np.concatenate([edges, [high + 1]])
        a, z = np.searchsorted(left, np.maximum(begin, low)), np.searchsorted(left, np.minimum(end, high), side="right")
        size = np.maximum(z - a, 0)
        row = np.repeat(np.arange(len(begin)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
        block, who = table.column("block").to_numpy(zero_copy_only=False), table.column("i").to_numpy()
        # at a set's own variant its blocks don't hold
        taken = np.unique(at[~block[row]] * 100_000 + who[row][~block[row]])
        fits = ~block[row] | ~np.isin(at * 100_000 + who[row], taken)
        row, at = row[fits], at[fits]
        order = np.lexsort((begin[row], who[row], at))
        row, at = row[order], at[order]
        have, n = np.unique(at, return_counts=True)
        r = table.column("r").combine_chunks().take(pa.array(row))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), r)
        goes_on = (left[have] == low) & (not firm)
        return pa.table([pa.array([key[0].as_py()] * len(have), pa.string()), pa.array(left[have], pa.int64()), pa.array(right[have] - 1, pa.int64()), pa.array(goes_on), lists], names=["CHROM", "POS", "LAST", "goes_on", "r"])

    binned = rows.withColumn("_b", cut)
    parts = settled(binned.groupBy("CHROM", "_b").applyInArrow(sweep, kind))
    places = parts.select("CHROM", F.col("POS").alias("p"), F.col("LAST").alias("z"), "goes_on").where(F.col("goes_on") | ((F.col("LAST") + 1) % width == 0))
    w = Window.partitionBy("CHROM").orderBy("p")  # two places for each bin at most
    places = places.withColumn("_run", F.sum(F.when(F.col("goes_on") & (F.lag("z").over(w) == F.col("p") - 1), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = places.groupBy("CHROM", "_run").agg(F.min("p").alias("p"), F.max("z").alias("z"))
    out = parts.join(whole.select(F.col("CHROM").alias("c"), "p", "z", F.lit(True).alias("_first")), (F.col("CHROM") == F.col("c")) & (F.col("POS") == F.col("p")), "left")
    return out.where(F.col("_first") | ~(F.col("goes_on") | ((F.col("LAST") + 1) % width == 0))).select("CHROM", "POS", F.coalesce("z", "LAST").alias("LAST"), "r")


def merge_gvcf(
    *call_sets: DataFrame, reference: DataFrame | None = None, policy: str = "all", numbers: Mapping[str, str] | None = None, info_rules: Mapping[str, str] | None = None,
    missing_rules: Mapping[str, str | float] | None = None, names: bool = False, width: int = BIN, reference_width: int | None = None,
) -> DataFrame:
    """Call sets in the nested layout as one: as alleles.merge_calls, with INFO_END. A record with INFO_END and no ALT but a symbolic one is a
    block; it is cut where another set's block or record begins or ends, and its calls stand at every piece. REF of a piece that
    begins inside a block is the reference's base, if blocks of a reference are given, else N.
    """
    symbolic = F.forall("ALT", lambda a: a.startswith("<"))
    own = [df.withColumns({"_block": F.col("INFO_END").isNotNull() & symbolic if "INFO_END" in df.columns else F.lit(False), "_last": F.greatest(F.coalesce(F.col("INFO_END").cast("long"), "POS"), "POS") if "INFO_END" in df.columns else F.col("POS")}) for df in call_sets]
    g = L.gathered([df.drop("INFO_END") for df in own], policy, numbers, ("_block", "_last"))
    rows = g.rows.select("CHROM", F.col("POS").cast("long").alias("POS"), F.when(F.col("_block"), F.col("_last")).otherwise(F.col("POS")).cast("long").alias("LAST"), F.col("_block").alias("block"), F.col("r.i").alias("i"), F.struct("r", F.col("POS").cast("long").alias("at"), "_block", "_g").alias("r"))
    t = swept(rows, width)
    # inside a block, its REF is not the piece's
    inner = F.transform("r", lambda x: F.when(x["at"] < F.col("POS"), x["r"].withField("REF", F.lit(""))).otherwise(x["r"]))
    variant = F.exists("r", lambda x: ~x["_block"])
    # variants that the policy keeps apart make a record each, every one with the other sets' blocks
    groups = F.array_distinct(F.transform(F.filter("r", lambda x: ~x["_block"]), lambda x: x["_g"]))
    t = t.withColumn("_k", F.explode(F.when(variant, groups).otherwise(F.array(F.lit(None).cast("string")))))
    fits = F.filter(F.arrays_zip(F.col("r").alias("o"), inner.alias("n")), lambda x: x["o"]["_block"] | F.col("_k").eqNullSafe(x["o"]["_g"]))
    t = t.select("CHROM", "POS", "LAST", variant.alias("_variant"), F.transform(fits, lambda x: x["n"]).alias("r"))
    out = L.merged(t, g, info_rules=info_rules if info_rules is not None else {k: v for k, v in INFO_RULES.items() if k in g.infos}, missing_rules=MISSING_RULES if missing_rules is None else missing_rules, names=names, keep=["LAST", "_variant"])
    out = out.withColumn("REF", F.when(F.col("REF") == "", "N").otherwise(F.col("REF")))
    if reference is not None:
        more = {} if reference_width is None else {"width": reference_width}
        out = filled_from_reference(out, reference, "REF", F.col("REF") == "N", **more)
    return out.withColumn("INFO_END", F.when(~F.col("_variant"), F.col("LAST"))).drop("LAST", "_variant")
