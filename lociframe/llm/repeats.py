"""Find the keys that occur at least twice in a corpus, without a JVM row for each occurrence.

Mappers give columns of fixed width (first the 64-bit key). They are packed into one binary per batch and hash bucket,
so that the shuffle moves dense arrays; a reducer sorts the keys of its buckets and drops those seen once.
A key that a batch holds twice is known to repeat: its rows pass through at once, spread over all buckets, and only a
marker goes to the key's bucket. So a bucket gets one row for each batch and key at most, however frequent the key is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lociframe.llm.common import lean, n_parts

PACKED = "bucket int, kind int, cols binary"
FLUSH = 800_000  # rows packed together
PASS = 20_000  # rows that need no company, in one pack


def _pack(rows: list[np.ndarray], bucket: np.ndarray, kind: int, n: int) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    rows = [r[order] for r in rows]
    for b in np.flatnonzero(edges[1:] > edges[:-1]):
        part = slice(edges[b], edges[b + 1])
        yield int(b), kind, b"".join(r[part].tobytes() for r in rows)


def _flush(parts: list[list[np.ndarray]], n: int) -> pa.RecordBatch | None:
    rows = [np.concatenate(c) for c in zip(*parts, strict=True)]
    if not len(rows[0]):
        return None
    order = np.lexsort((rows[1], rows[0]))
    rows = [r[order] for r in rows]
    new = np.ones(len(order), bool)
    new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
    rows = [r[new] for r in rows]
    key = k = rows[0]
    order = np.arange(len(k))
    twice = np.zeros(len(k), bool)
    same = k[1:] == k[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    first = np.ones(len(k), bool)
    first[1:] = ~same
    home = lambda x: (x.view(np.uint64) >> np.uint64(40)).astype(np.int64) % n
    once, many, mark = order[~twice], order[twice], k[twice & first]
    out = [*_pack([r[once] for r in rows], home(key[once]), 0, n), *_pack([r[many] for r in rows], (np.arange(len(many)) // PASS + int(k[:1].sum())) % n, 1, n), *_pack([mark], home(mark), 2, n)]
    return pa.record_batch([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["bucket", "kind", "cols"])


def repeated(df: DataFrame, mapper: Callable[[pa.RecordBatch], Iterator[list[np.ndarray]]], schema: list[tuple[str, str]]) -> DataFrame:
    """Rows that mapper makes of df's batches, for keys (the first column) with at least two values in the second column.

    schema: names with numpy dtypes 'i8' or 'i4', the first two 'i8'. Equal (key, second) pairs of a batch become one row.
    """
    n = n_parts(df.sparkSession)
    types = [np.dtype(t) for _, t in schema]
    width = sum(t.itemsize for t in types)

    def pack(batches):
        parts, held = [], 0
        for batch in batches:
            for rows in mapper(batch):
                parts.append(rows)
                held += len(rows[0])
                if held >= FLUSH:
                    if (out := _flush(parts, n)) is not None:
                        yield out
                    parts, held = [], 0
        if parts and (out := _flush(parts, n)) is not None:
            yield out

    def unpack(blobs: list[bytes]) -> list[np.ndarray]:
        cols: list[list[np.ndarray]] = [[] for _ in types]
        for b in blobs:
            m, at = len(b) // width, 0
            for c, t in zip(cols, types, strict=True):
                c.append(np.frombuffer(b, t, m, at))
                at += m * t.itemsize
        return [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(cols, types, strict=True)]

    def table(cols: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c) for c in cols], names=[name for name, _ in schema])

    def keep(batches):
        single: list[bytes] = []
        marks: list[np.ndarray] = []
        for batch in batches:
            kinds, blobs = batch.column("kind").to_pylist(), batch.column("cols").to_pylist()
            single += [b for k, b in zip(kinds, blobs, strict=True) if k == 0]
            marks += [np.frombuffer(b, np.int64) for k, b in zip(kinds, blobs, strict=True) if k == 2]
            if passed := [b for k, b in zip(kinds, blobs, strict=True) if k == 1]:
                yield table(unpack(passed))
        cols = unpack(single)
        single.clear()
        order = np.lexsort((cols[1], cols[0]))
        cols = [c[order] for c in cols]
        key, second = cols[:2]
        if not len(key):
            return
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new = new_key | np.concatenate([[True], second[1:] != second[:-1]])
        group = np.cumsum(new_key) - 1
        several = (np.bincount(group, weights=new)[group] > 1) | np.isin(key, np.concatenate([np.zeros(0, np.int64), *marks]))
        found = np.flatnonzero(several & new)
        for i in range(0, len(found), 200_000):
            yield table([c[found[i : i + 200_000]] for c in cols])

    ddl = ", ".join(f"{name} {'long' if t == 'i8' else 'int'}" for name, t in schema)
    return df.mapInArrow(lean(pack), PACKED).repartitionById(n, "bucket").mapInArrow(lean(keep), ddl)
