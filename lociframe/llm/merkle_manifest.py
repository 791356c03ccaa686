"""Merkle manifests of datasets, with checkpoint-and-recompute.

The rows of each tree, in order, are its leaves; every ARITY consecutive nodes become the digest of their digests, until one
is left, the subroot. Subroots, in order of their trees, are the leaves of a last tree, whose top is the manifest's root.
Only every EVERY-th level is stored, in blocks of ARITY^EVERY nodes: the leaves of one aligned subtree each, whose top is a node of the
next stored level. A proof's siblings between two stored levels are computed anew from the block, handed out and forgotten.

A leaf's digest is all that leaves its task: texts are hashed where they are read. A place in a tree comes from a sort over all tasks, so
a tree of any size, or a source that holds a third of all rows, is dealt evenly, and so are blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.llm.common import discard, lean, materialise, n_parts

ARITY, EVERY = 3, 4
BLOCKS = 64  # whose proofs are in a task's memory at once
PATH = "array<struct<left:string,right:string>>"


def digest(values: Sequence[str]) -> str:
    return sha256("".join(values).encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """Hex digest of values, each with its length in bytes, so that no two lists of values give one input."""
    one = lambda v: F.coalesce(F.concat(F.octet_length(v.cast("string")), F.lit(":"), v.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, values)).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's hex digest and a proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """Hex digest of all siblings of a proof, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


@dataclass
class Manifest:
    """Stored levels of the trees and of the tree over their subroots, lowest first; `root` is None for no rows.

    levels, top: tree, n (leaves of the tree), block, nodes (array of pos, digest, and on the lowest level row).
    subroots: tree, n, digest."""

    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None
    arity: int
    every: int


def placed(rows: DataFrame, order: Sequence[str], made: list[str]) -> DataFrame:
    """rows with `pos`, the place from 0 in their tree by `order`, and `n`, the rows of their tree. Rows alike in all of
    these columns are in any order, and are dealt over tasks too."""
    by = ["tree", *order, "__tie"]
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n_parts(rows.sparkSession), *by).sortWithinPartitions(*by).drop("__tie")
    dealt = materialise(dealt.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), made)  # seq counts within a task
    ends = dealt.groupBy("tree", "part").agg(F.min("seq").alias("first"), F.count("*").alias("m"))
    whole = Window.partitionBy("tree")  # a row for each task that has rows of the tree
    before = F.coalesce(F.sum("m").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("part", "tree", (before - F.col("first")).alias("shift"), F.sum("m").over(whole).alias("n"))
    return dealt.join(ends, ["part", "tree"]).withColumn("pos", F.col("seq") + F.col("shift")).drop("part", "seq", "shift")


def _climb(nodes: list[str], steps: int, arity: int) -> list[list[str]]:
    """nodes and the levels above them, up to `steps`."""
    levels = [nodes]
    for _ in range(steps):
        below = levels[-1]
        levels.append([digest(below[i : i + arity]) for i in range(0, len(below), arity)])
    return levels


def _steps(n: int, level: int, arity: int, every: int) -> int:
    """Levels from a stored one to the next stored one, or to the top of a tree of n leaves."""
    height = 0
    while n > 1:
        n, height = -(-n // arity), height + 1
    return max(0, min(every, height - level))


def _in_blocks(rows: DataFrame, width: int, *carry: str) -> DataFrame:
    nodes = F.sort_array(F.collect_list(F.struct("pos", "digest", *carry)))
    return materialise(rows.groupBy("tree", "n", F.expr(f"pos div {width}").alias("block")).agg(nodes.alias("nodes")))


def _lists(batch: pa.RecordBatch) -> tuple[list[int], pa.StructArray]:
    nodes = batch.column("nodes")
    at = [o - nodes.offsets[0].as_py() for o in nodes.offsets.to_pylist()]
    return at, nodes.flatten()


def _tree(rows: DataFrame, order: Sequence[str], arity: int, every: int) -> tuple[list[DataFrame], DataFrame]:
    """Stored levels of the trees of rows (tree, digest, row and the columns of order), and subroots."""
    level, levels, subroots, carry, made, spark = 0, [], None, ["row"], [], rows.sparkSession
    rows, width = placed(rows, order, made), arity**every
    while True:
        stored = _in_blocks(rows, width, *carry)
        if not level:
            discard(spark, made)

        def tops(batches, level=level):
            for batch in batches:
                at, nodes = _lists(batch)
                hexes = [d.hex() for d in nodes.field("digest").to_pylist()]
                out = [bytes.fromhex(_climb(hexes[at[i] : at[i + 1]], _steps(n, level, arity, every), arity)[-1][0]) for i, n in enumerate(batch.column("n").to_pylist())]
                yield pa.record_batch([batch.column("tree"), batch.column("n"), batch.column("block"), pa.array(out, pa.binary())], names=["tree", "n", "pos", "digest"])

        up = materialise(stored.mapInArrow(lean(tops), "tree string, n long, pos long, digest binary"), made)
        levels.append(stored)
        level, carry = level + every, []
        done = up.where(F.col("n") <= arity**level).select("tree", "n", "digest")
        subroots = done if subroots is None else subroots.unionByName(done)
        rows = up.where(F.col("n") > arity**level)
        if rows.isEmpty():
            subroots = materialise(subroots)
            discard(spark, made)
            return levels, subroots


def build_manifest(leaves: DataFrame, tree: Column, order: Sequence[str], leaf: Column, carry: Sequence[str] = (), arity: int = ARITY, every: int = EVERY) -> Manifest:
    """The manifest of leaves: a tree for each value of `tree` (a string; null is a tree of its own, the first), leaves by
    `order`, nulls first, then by digest; equal rows are leaves each. `leaf` is a hex digest. `order` and `carry` columns
    come back with the proofs. An empty table has no tree and no root."""
    kept = list(dict.fromkeys([*order, *carry]))
    # "" stands for null and sorts first; other names get a letter in front
    rows = leaves.select(F.coalesce(F.concat(F.lit("="), tree), F.lit("")).alias("tree"), F.unhex(leaf).alias("digest"), F.struct(*kept).alias("row"), *(F.col(c).alias(f"__by{i}") for i, c in enumerate(order)))
    levels, subroots = _tree(rows, [*(f"__by{i}" for i in range(len(order))), "digest"], arity, every)
    top, root = _tree(subroots.select(F.lit("").alias("tree"), "digest", F.struct("tree", "digest").alias("row"), F.col("tree").alias("__by0")), ["__by0"], arity, every)
    found = root.select(F.lower(F.hex("digest"))).first()
    return Manifest(levels, subroots, top, found[0] if found else None, arity, every)


def _down(levels: list[DataFrame], above: DataFrame, carry: Sequence[str], arity: int, every: int) -> DataFrame:
    """Proofs of the leaves of trees. above: tree, n, path of the tree's top, and columns `carry`, which every leaf gets."""
    extra = above.schema
    kinds = {c: extra[c].dataType for c in carry}
    paths = None
    for k in reversed(range(len(levels))):
        level, lowest = k * every, k == 0
        own = above.where(F.col("n") <= arity ** (level + every)).select(F.col("tree").alias("t"), F.lit(0).cast("long").alias("b"), "path", *carry)
        paths = own if paths is None else own.unionByName(paths)
        rows = levels[k].join(paths, (F.col("tree") == F.col("t")) & (F.col("block") == F.col("b"))).drop("t", "b")
        row = levels[0].schema["nodes"].dataType.elementType["row"].dataType if lowest else None

        def prove(batches, level=level, lowest=lowest):
            for whole in batches:
                for begin in range(0, whole.num_rows, BLOCKS):
                    batch = whole.slice(begin, BLOCKS)
                    at, nodes = _lists(batch)
                    hexes, lefts, rights, ends, repeat = [d.hex() for d in nodes.field("digest").to_pylist()], [], [], [0], []
                    for i, (n, path) in enumerate(zip(batch.column("n").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                        inner = _climb(hexes[at[i] : at[i + 1]], _steps(n, level, arity, every), arity)[:-1]
                        up_left, up_right = [s["left"] for s in path], [s["right"] for s in path]
                        for j in range(at[i + 1] - at[i]):
                            for below in inner:
                                first = j // arity * arity
                                lefts.append("".join(below[first:j]))
                                rights.append("".join(below[j + 1 : first + arity]))
                                j //= arity
                            lefts += up_left
                            rights += up_right
                            ends.append(len(lefts))
                            repeat.append(i)
                    pairs = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], ["left", "right"])
                    proof, which = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), pa.array(repeat, pa.int64())
                    again = [batch.column(c).take(which) for c in carry]
                    if lowest:
                        yield pa.record_batch([nodes.field("row"), nodes.field("digest"), proof, *again], names=["row", "digest", "path", *carry])
                    else:
                        yield pa.record_batch([batch.column("tree").take(which), nodes.field("pos"), proof, *again], names=["t", "b", "path", *carry])

        more = "".join(f", {c} {t.simpleString()}" for c, t in kinds.items())
        kind = f"row {row.simpleString()}, digest binary, path {PATH}" if lowest else f"t string, b long, path {PATH}"
        paths = rows.mapInArrow(lean(prove), kind + more)
    return paths


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: row (its order and carried columns), leaf, subroot (hex) and proof, an array of the siblings left and
    right of the path at every level from the leaf to the root, as hex digests joined (empty where there are none)."""
    m = manifest
    start = m.top[0].select("tree", "n").distinct().withColumn("path", F.expr(f"cast(array() as {PATH})"))
    trees = _down(m.top, start, [], m.arity, m.every)
    trees = materialise(trees.select(F.col("row.tree").alias("tree"), F.lower(F.hex("digest")).alias("subroot"), "path"))
    above = trees.join(m.subroots.select(F.col("tree").alias("t"), "n"), F.col("tree") == F.col("t")).drop("t")
    return _down(m.levels, above, ["subroot"], m.arity, m.every).select("row", F.lower(F.hex("digest")).alias("leaf"), "subroot", F.col("path").alias("proof"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 != 0
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.unhex(leaf_digest(*others, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    leaves = docs.select("doc_id", "source", leaf_digest(*others, F.col("text")).alias("leaf"), F.when(odd | ~F.contains(F.coalesce("text", F.lit("")), F.lit("\n")), F.lit(None)).otherwise(changed).alias("tampered"))
    manifest = build_manifest(leaves, F.col("source"), ["doc_id"], F.col("leaf"), ["tampered"])
    root, seen = F.lit(manifest.root), F.coalesce(F.lower(F.hex("row.tampered")), "leaf")
    found = proofs(manifest).select(F.col("row.doc_id").alias("doc_id"), "leaf", "subroot", root.alias("root"), siblings(F.col("proof")).alias("proof_sha256"), folded(seen, F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
