"""Suffix-array dedup: remove bytes that 100-byte strings repeat, found by deep-shallow suffix sorting.

A distributed suffix sort of the suffixes that can have an equal LENGTH-byte prefix: those whose winnowed seed occurs
elsewhere in another context (see `winnow`; runs whose whole context is a copy are settled there). Each task sorts the
suffixes of its texts and drops those equal to an earlier one; the rest go, with their bytes, to the part of the suffix
array that their seed belongs to, or their own first LENGTH bytes where a seed is crowded. Equal suffixes are in one part;
each part is sorted, and neighbours whose common prefix has LENGTH bytes are copies, all but the earliest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import BASE_INV, BYTE, buffers, chunks, doc_id, keyed, lean, materialise, mix, n_parts, powers, prefix_sums
from lociframe.llm.repeats import PACKED
from lociframe.llm.winnow import FOUND, SPAN, covered, home_of, packs, per_doc, resolve, run_lists, seed_runs, stretches, table, windows_of

LENGTH, SEED, SHALLOW = 100, 32, 16
SORT_BYTES = 1_000_000  # text whose suffixes a task sorts at once in the mapper
SORT_MOST = 1_000_000  # suffixes of a part sorted at once; larger parts are split by their leading bytes
RUNS, COPIES = 0, 1  # kinds of packs
HEAD = [np.dtype(t) for t in ("i8", "i4", "i4")]  # k, at, n of a run


def symbols(raw: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gives the 8 bytes from positions on as big-endian numbers; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    view = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    return lambda at: view[at].byteswap()


def _regroup(order: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partition every group by key at once; groups are numbered by the place of their first member."""
    by = np.lexsort((key, group))
    order, group, key = order[by], group[by], key[by]
    new = np.ones(len(order), bool)
    new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    place = np.arange(len(order)) - np.searchsorted(group, group)
    return order, np.maximum.accumulate(np.where(new, group + place, 0))


def _tied(group: np.ndarray) -> np.ndarray:
    same = np.zeros(len(group), bool)
    same[1:] = group[1:] == group[:-1]
    same[:-1] |= same[1:]
    return same


def deep_shallow_sort(raw: np.ndarray, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `length` bytes, and for each whether its common prefix with the one before
    has that length. Every suffix must have `length` bytes.

    Shallow phase: multikey quicksort on symbols of 8 bytes down to `shallow` bytes; the partitions of all groups of one
    depth are made together. Deep phase: groups that still tie go through a blind trie each. A node skips to the first
    symbol in which the group's members differ, without looking at the order of what it skips, and branches there.
    """
    at = [*range(0, length - 7, 8), *([length - 8] if length % 8 and length > 8 else [])]
    sym = symbols(raw)
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    n_shallow = max(1, shallow // 8)
    for depth in at[:n_shallow]:
        tied = np.ones(len(order), bool) if depth == 0 else _tied(group)
        if not tied.any():
            break
        order[tied], group[tied] = _regroup(order[tied], group[tied], sym(starts[order[tied]] + depth))
    open_ = np.flatnonzero(_tied(group)) if len(at) > n_shallow else np.zeros(0, np.int64)
    rest = np.asarray(at[n_shallow:])
    while len(open_):
        o, g = order[open_], group[open_]
        branch = _branches(sym, starts[o], g, rest)
        go = branch < len(rest)
        if not go.any():
            break
        order[open_[go]], group[open_[go]] = _regroup(o[go], g[go], sym(starts[o[go]] + rest[branch[go]]))
        left = open_[go]
        open_ = left[_tied(group[left])]
    equal = np.zeros(len(order), bool)
    equal[1:] = group[1:] == group[:-1]
    return order, equal


def _branches(sym: Callable[[np.ndarray], np.ndarray], start: np.ndarray, group: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """For suffixes sorted by group: the first place in rest where the members of each one's group differ, or len(rest)."""
    out = np.full(len(start), len(rest))
    live = np.arange(len(start))
    for d, depth in enumerate(rest):
        new = np.ones(len(live), bool)
        new[1:] = group[live[1:]] != group[live[:-1]]
        first, key = np.flatnonzero(new), sym(start[live] + depth)
        nth = np.cumsum(new) - 1
        parts = np.logical_or.reduceat(key != key[first[nth]], first)[nth]
        out[live[parts]] = d
        live = live[~parts]
        if not len(live):
            break
    return out


Sort = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def sorted_copies(raw: np.ndarray, starts: np.ndarray, k: np.ndarray, at: np.ndarray, length: int, sort: Sort) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes at starts in raw, of document k and place at, have an equal one with smaller (k, at), and which have
    the smallest (k, at) of their equals; of the same (k, at) twice one has. Both as masks."""
    copy, head = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    for some in _splits(raw, starts):
        order, equal = sort(raw, starts[some], length)
        order, cls = some[order], np.cumsum(~equal)
        by = np.lexsort((at[order], k[order], cls))
        order, cls = order[by], cls[by]
        new = np.ones(len(order), bool)
        new[1:] = cls[1:] != cls[:-1]
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        copy[order] = (k[order] != k[lead]) | (at[order] != at[lead])
        head[order[new]] = True
    return copy, head


def _splits(raw: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """Suffixes in groups of about SORT_MOST at most by sampled splitters of their leading bytes."""
    if len(starts) <= SORT_MOST:
        yield np.arange(len(starts))
        return
    lead = symbols(raw)(starts)
    cuts = np.unique(np.quantile(lead[:: max(1, len(lead) // 10_000)], np.linspace(0, 1, len(starts) // SORT_MOST + 2)[1:-1], method="nearest"))
    part = np.searchsorted(cuts, lead, side="right")
    for p in range(len(cuts) + 1):
        yield np.flatnonzero(part == p)


def _packed(k: np.ndarray, at: np.ndarray, n: np.ndarray, text: list[bytes] | None, bucket: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """Runs by bucket: their number, the columns of HEAD, their bytes."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1], [True]])) if len(order) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = order[a:b]
        head = [np.int64(len(own)).tobytes(), *(x[own].astype(t).tobytes() for x, t in zip((k, at, n), HEAD, strict=True))]
        yield int(bucket[own[0]]), kind, b"".join([*head, *(text[x] for x in own)] if text is not None else head)


def _unpacked(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    m, cols, at = int(np.frombuffer(blob, np.int64, 1)[0]), [], 8
    for t in HEAD:
        cols.append(np.frombuffer(blob, t, m, at))
        at += m * t.itemsize
    return cols, blob[at:]


def repeated_bytes(docs: DataFrame, length: int = LENGTH, seed: int = SEED, sort: Sort = deep_shallow_sort) -> DataFrame:
    """Runs (k, at, n, home) of string starts: each string of `length` bytes also starts earlier; docs: k, text."""
    n = n_parts(docs.sparkSession)

    def seeds(batch):
        ks, (raw, offs) = batch.column("k").to_numpy(), buffers(batch.column("text"))
        for i, j in chunks(offs):
            s, c, text, at, n_windows, _ = seed_runs(BYTE[raw[offs[i] : offs[j]]], offs[i : j + 1] - offs[i], length, seed)
            yield [s, c, ks[i + text], at.astype(np.int32), n_windows.astype(np.int32)]

    def suffixes(batches):
        """A batch's suffixes, sorted; of equal ones the first travels, in one run with its neighbours of one seed."""
        for batch in batches:
            ks, runs, (raw, offs) = batch.column("k").to_numpy(), run_lists(batch), buffers(batch.column("text"))
            out = []
            for i, j in chunks(offs, SORT_BYTES):
                found = [windows_of(r) for r in runs[i:j]]
                row = np.repeat(np.arange(i, j), [len(at) for at, _ in found])
                if not len(row):
                    continue
                at, home = (np.concatenate(x) for x in zip(*found, strict=True))
                fits = at + length <= (offs[1:] - offs[:-1])[row]
                row, at, home = row[fits], at[fits], home[fits]
                part, k = raw[offs[i] : offs[j]], ks[row]
                start = at + offs[row] - offs[i]
                copy, head = sorted_copies(part, start, k, at, length, sort)
                first, size = stretches(k[copy], at[copy])
                out += _packed(k[copy][first], at[copy][first], size, None, (first + int(offs[i])) % n, COPIES)
                k, at, home, start = k[head], at[head], home[head], start[head]
                alone = home < 0
                first, size = stretches(k, at, home, np.where(alone, np.arange(len(k)), -1))
                one, home = prefix_sums(BYTE[part]), home[first]
                s = start[first]
                own = home_of(mix((one[s + length] - one[s]) * powers(BASE_INV, len(part) + 1)[s]), n)
                data = part.tobytes()
                text = [data[x : x + m] for x, m in zip(s.tolist(), (size + length - 1).tolist(), strict=True)]
                out += _packed(k[first], at[first], size, text, np.where(home < 0, own, home), RUNS)
            yield packs(out)

    def meet(batches):
        heads, texts = [], []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("cols").to_pylist(), strict=True):
                cols, text = _unpacked(blob)
                if kind == COPIES:
                    yield from table(SPAN, *cols)
                else:
                    heads.append(cols)
                    texts.append(text)
        if not heads:
            return
        k, at, size = (np.concatenate(c) for c in zip(*heads, strict=True))
        raw = np.frombuffer(b"".join(texts), np.uint8)
        texts.clear()
        long = size.astype(np.int64) + length - 1
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        start, k, at = np.repeat(np.cumsum(long) - long, size) + nth, np.repeat(k, size), np.repeat(at, size) + nth
        copy, _ = sorted_copies(raw, start, k, at, length, sort)
        first, size = stretches(k[copy], at[copy])
        yield from table(SPAN, k[copy][first], at[copy][first], size)

    found = materialise(resolve(docs, seeds, within=True))
    left = per_doc(docs, found.where(F.col("role") != SPAN)).where("runs is not null")
    copies = left.mapInArrow(lean(suffixes), PACKED).repartitionById(n, "bucket").mapInArrow(lean(meet), FOUND)
    return found.where(F.col("role") == SPAN).unionByName(copies).select("k", "at", "n", "home")


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, sort: Sort = deep_shallow_sort) -> DataFrame:
    """One row per row of documents: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    A byte of the UTF-8 text is removed if a string of `length` bytes covers it that also starts earlier: in a document
    with a smaller doc_id, or in the same one before. Strings are judged on the input and never cross documents.
    Null or empty text: no bytes, kept empty. A null doc_id comes before all others. Rows that share a doc_id are one
    document here: equal strings at equal places of them are one string, and all rows are returned. Other columns are ignored.
    """
    own = keyed(docs)

    def cut(batches):
        for batch in batches:
            raw, offs = buffers(batch.column("text"))
            n_bytes, n_removed, n_spans, kept = np.diff(offs), [], [], []
            for r, runs in enumerate(run_lists(batch)):
                part = raw[offs[r] : offs[r + 1]]
                gone = covered(runs, length, len(part)) if len(runs) else np.zeros(len(part), bool)
                n_removed.append(int(gone.sum()))
                n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                kept.append((part[~gone] if n_removed[-1] else part).tobytes())
            yield pa.record_batch([batch.column("k"), pa.array(n_bytes), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=["k", "n_bytes", "n_removed", "n_spans", "kept"])

    out = per_doc(own, repeated_bytes(own, length, seed, sort)).mapInArrow(lean(cut), "k long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(doc_id(), "n_bytes", "n_removed", "n_spans", "kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
