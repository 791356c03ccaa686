"""Windows of fixed length that occur more than once in a corpus, found from winnowed seeds.

Every window of `width` symbols (bytes or words) selects the seed of `seed` symbols with the smallest hash in it, the
leftmost of equals. Equal windows select the same seed at the same offset, so they meet under that seed's hash.
Neighbouring windows that select one seed form a run; the symbols a run covers are its context. Two rounds follow:

1. Runs meet by (seed, context). A run whose whole context begins earlier elsewhere is a copy: all its windows are.
   Where a seed has one context only, nothing else can match. What is left are first runs of seeds with several contexts.
2. These are compared symbol by symbol, in the way of the operator that asks: by sorting suffixes or by extending seeds.
   All runs of a seed meet in its bucket, each with its own symbols. A crowded seed, which a bucket could not hold, has
   its windows dealt out one by one.

Both rounds combine in the mapper: of what a batch holds twice only the first travels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import BASE_INV, as_long, lean, mix, n_parts, powers, prefix_sums
from lociframe.llm.repeats import FLUSH, PACKED, PASS, _pack

POS_BITS = np.uint64(30)
POS_MASK = np.uint64((1 << 30) - 1)
CROWD, MEET = 64, 512  # contexts of one seed, in a batch and in its bucket, beyond which it is crowded
TYPES = [np.dtype(t) for t in ("i8", "i8", "i8", "i4", "i4")]  # seed, context, k, at, n
WIDTH = sum(t.itemsize for t in TYPES)
SPAN, REP, CROWDED = 0, 1, 2
FOUND = "role int, k long, at int, n int, home int"


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n neighbours."""
    out, have = x, 1
    while have * 2 <= n:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == n else np.minimum(out[: len(x) - n + 1], out[n - have :][: len(x) - n + 1])


def seed_runs(values: np.ndarray, offs: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, ...]:
    """For the symbols' values and each text's first symbol: seed hash, context hash, text, first window, windows, and the
    seed's place in the first window, of each run."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    count = np.maximum(offs[1:] - offs[:-1] - width + 1, 0)
    if not count.sum():
        return none
    prefix = prefix_sums(values)
    n_seeds = len(values) - seed + 1
    seeds = mix((prefix[seed:] - prefix[:n_seeds]) * powers(BASE_INV, n_seeds))
    packed = (seeds & ~POS_MASK) | np.arange(n_seeds, dtype=np.uint64)
    best = sliding_min(packed, width - seed + 1) & POS_MASK
    text = np.repeat(np.arange(len(count)), count)
    window = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offs[:-1], count)
    anchor = best[window].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.diff(np.append(first, len(anchor)))
    start, anchor, text = window[first], anchor[first], text[first]
    context = (prefix[start + n - 1 + width] - prefix[start]) * powers(BASE_INV, len(values))[start]
    context = mix(context ^ mix(((anchor - start) * 65536 + n).astype(np.uint64)))
    return as_long(seeds[anchor]), as_long(context), text, start - offs[:-1][text], n, anchor - start


def windows_of(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct window starts of runs (at, n, home), and each one's home."""
    if not len(runs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, first = np.unique(np.repeat(runs[:, 0] - np.cumsum(runs[:, 1]) + runs[:, 1], runs[:, 1]) + np.arange(runs[:, 1].sum()), return_index=True)
    return at, np.repeat(runs[:, 2], runs[:, 1])[first]


def stretches(k: np.ndarray, at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of windows begin that follow one another in one k, alike in `same`, and how many windows each has."""
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1)
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(k)))


def _classes(rows: list[np.ndarray], within: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows sorted by (seed, context, k, at); which begin a (seed, context); which are copies of an earlier one."""
    seed, context, k, at, _ = rows
    order = np.lexsort((at, k, context, seed))
    rows = [r[order] for r in rows]
    seed, context, k, at, _ = rows
    new = np.ones(len(seed), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (context[1:] != context[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(seed)), 0)) if len(seed) else np.zeros(0, np.int64)
    copy = (k > k[head]) | (at != at[head]) if within else k > k[head]
    return rows, new, copy


def _group_sizes(seed: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """For sorted seeds: the number of rows `counted` in each row's seed."""
    if not len(seed):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], seed[1:] != seed[:-1]])
    group = np.cumsum(new) - 1
    return np.bincount(group, weights=counted)[group].astype(np.int64)


def _folded(rows: list[np.ndarray], first: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted rows of which `first` begin a (seed, context), all of a (seed, context) from one k: single windows that follow
    one another become one row, whose n is minus their number."""
    at, n = rows[3:]
    begin = np.ones(len(at), bool)
    begin[1:] = first[1:] | (n[1:] != 1) | (n[:-1] != 1) | (at[1:] - at[:-1] > 1)
    begin = np.flatnonzero(begin)
    end = np.append(begin[1:], len(at)) - 1
    size = at[end] - at[begin] + 1
    rows = [r[begin] for r in rows]
    rows[4] = np.where(size > 1, -size, rows[4]).astype(n.dtype)
    return rows, first[begin]


def _unfolded(k: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.maximum(-n, 1)
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(k, size), (np.repeat(at, size) + nth).astype(np.int32), np.maximum(np.repeat(n, size), 1).astype(np.int32)


def home_of(x: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a hash, of n."""
    return (x.view(np.uint64) >> np.uint64(40)).astype(np.int64) % n


PLAIN, MARKS, COPIES, CROWDS = 0, 2, 3, 1  # kinds of packs


def combined(parts: list[list[np.ndarray]], within: bool, n: int, last: bool = False) -> list[tuple[int, int, bytes]]:
    """Packs (bucket, kind, bytes) of rows (seed, context, k, at, n): what a batch shows to be copies, and what has to meet."""
    rows, new, copy = _classes([np.concatenate(c) for c in zip(*parts, strict=True)], within)
    spans, rest, first = [r[copy] for r in rows], [r[~copy] for r in rows], new[~copy]
    if not within:
        rest, first = _folded(rest, first)
    crowd = (_group_sizes(rest[0], first) > CROWD) & (not last)
    marks = np.unique(rest[0][crowd])
    spread = lambda x: (np.arange(len(x)) // PASS + int(x[:1].sum())) % n
    return [*_pack(spans, spread(spans[0]), COPIES, n), *_pack([r[crowd] for r in rest], spread(rest[0][crowd]), CROWDS, n), *_pack([r[~crowd] for r in rest], home_of(rest[0][~crowd], n), PLAIN, n), *_pack([marks], home_of(marks, n), MARKS, n)]


def packs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.binary())], names=["bucket", "kind", "cols"])


def columns(blobs: list[bytes], types: list[np.dtype] = TYPES) -> list[np.ndarray]:
    """The columns of packs."""
    width = sum(t.itemsize for t in types)
    cols: list[list[np.ndarray]] = [[] for _ in types]
    for b in blobs:
        m, at = len(b) // width, 0
        for c, t in zip(cols, types, strict=True):
            c.append(np.frombuffer(b, t, m, at))
            at += m * t.itemsize
    return [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(cols, types, strict=True)]


def table(role: int, k: np.ndarray, at: np.ndarray, n: np.ndarray, home: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of FOUND."""
    for i in range(0, len(k), 200_000):
        part = slice(i, i + 200_000)
        cols = [np.full(len(k[part]), role), k[part], at[part], n[part], np.full(len(k[part]), -1) if home is None else home[part]]
        yield pa.record_batch([pa.array(c.astype(np.int64 if j == 1 else np.int32)) for j, c in enumerate(cols)], names=["role", "k", "at", "n", "home"])


def met(plain: list[bytes], marks: list[np.ndarray], within: bool, n: int, last: bool = False) -> Iterator[pa.RecordBatch]:
    """What the rows of a bucket come to."""
    rows, new, copy = _classes(columns(plain), within)
    plain.clear()
    yield from table(SPAN, *_unfolded(*(r[copy] for r in rows[2:])))
    if not last:
        size, rest = _group_sizes(rows[0], new), ~copy
        crowded = np.isin(rows[0], np.concatenate([np.zeros(0, np.int64), *marks])) | (size > MEET)
        yield from table(CROWDED, *_unfolded(*(r[rest & crowded] for r in rows[2:])))
        some = rest & ~crowded & (size > 1)
        seed = np.repeat(rows[0][some], np.maximum(-rows[4][some], 1))
        yield from table(REP, *_unfolded(*(r[some] for r in rows[2:])), home_of(seed, n))


def resolve(df: DataFrame, mapper: Callable[[pa.RecordBatch], Iterator[list[np.ndarray]]], within: bool) -> DataFrame:
    """Round 1, of mapper's rows (seed, context, k, at, n): FOUND has as SPAN those with an equal (seed, context) earlier,
    that is of smaller k or, if within, of smaller (k, at); as REP first rows of a seed that has several contexts, with the
    seed's bucket; as CROWDED the same where the seed has too many of them. All rows of a seed are in one of the latter two.

    A batch sends to a seed's bucket what one document has of CROWD contexts, at most."""
    n = n_parts(df.sparkSession)

    def pack(batches):
        parts, held = [], 0
        for batch in batches:
            for rows in mapper(batch):
                parts.append(rows)
                held += len(rows[0])
                if held >= FLUSH:
                    yield packs(combined(parts, within, n))
                    parts, held = [], 0
        if held:
            yield packs(combined(parts, within, n))

    def meet(batches):
        plain, marks = [], []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("cols").to_pylist(), strict=True):
                if kind == PLAIN:
                    plain.append(blob)
                elif kind == MARKS:
                    marks.append(np.frombuffer(blob, np.int64))
                else:
                    yield from table(SPAN if kind == COPIES else CROWDED, *_unfolded(*columns([blob])[2:]))
        yield from met(plain, marks, within, n)

    return df.mapInArrow(lean(pack), PACKED).repartitionById(n, "bucket").mapInArrow(lean(meet), FOUND)


def per_doc(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (k, text, ...) with `runs`, the (at, n, home) found in each; a text's runs are at most as many as its symbols."""
    runs = found.groupBy(F.col("k").alias("k2")).agg(F.collect_list(F.struct("at", "n", "home")).alias("runs"))
    return docs.join(runs, F.col("k") == F.col("k2"), "left").drop("k2")


def run_lists(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The runs of each row as an array of (at, n, home)."""
    col = batch.column("runs")
    offs, items = col.offsets.to_numpy(), col.values
    cols = np.stack([items.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "home")], 1) if len(items) else np.zeros((0, 3), np.int64)
    return [cols[i:j].astype(np.int64) for i, j in zip(offs[:-1], offs[1:], strict=True)]


def covered(runs: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which of `total` symbols the windows of runs (at, n) cover."""
    edge = np.zeros(total + 1, np.int64)
    runs = runs[(runs[:, 0] >= 0) & (runs[:, 0] + runs[:, 1] - 1 + width <= total)]
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1] - 1 + width, -1)
    return np.cumsum(edge)[:total] > 0
