"""Substring dedup by seed and extend: remove words that longer passages repeat from documents with smaller ids.

Documents join on winnowed seeds of SEED words (see `winnow`, which settles runs whose whole context is a copy). All runs of a
seed meet in its bucket, and each is extended both ways, word by word, against every run of a smaller document: the
windows of WINDOW words inside what matches are repeats. Where a seed is crowded, its windows meet one by one, by hash.
Overlapping windows merge to maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import BASE_INV, as_long, buffers, chunks, doc_id, keyed, lean, materialise, mix, n_parts, powers, prefix_sums, word_hashes, words
from lociframe.llm.repeats import PACKED
from lociframe.llm.winnow import COPIES, FOUND, PLAIN, SPAN, _unfolded, columns, combined, covered, met, packs, per_doc, resolve, run_lists, seed_runs, stretches, table, windows_of

WINDOW, SEED = 50, 16
RUNS = 4  # kind of packs of runs, beside those of windows
TOGETHER = 20_000  # runs extended at once, about
HEAD = [np.dtype(t) for t in ("i8", "i4", "i4")]  # k, at, n of a run


def _word_values(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For row ranges (i, j): the words' hashes and each row's first word."""
    raw, offs = buffers(text)
    for i, j in chunks(offs):
        part, at = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        start, end, first = words(part, at)
        yield i, j, word_hashes(part, start, end), first


def _matched(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many leading columns rows agree."""
    return np.argmin(np.concatenate([own == other, np.zeros((len(own), 1), bool)], 1), 1)


def extended(values: np.ndarray, offs: np.ndarray, k: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Run and window of every window that a run of the same seed and smaller k has too; values: the runs' words."""
    seeds, _, _, _, n, place = seed_runs(values, offs, window, seed)
    order = np.lexsort((k, seeds))
    seeds, k, n, place, run = seeds[order], k[order], n[order], place[order], order
    reach = window - seed  # words that a window has beside the seed
    padded = np.concatenate([np.zeros(reach, np.uint64), values, np.zeros(reach, np.uint64)])
    at, end = offs[:-1][run] + place, offs[1:][run]
    x = np.arange(reach)
    edges = np.flatnonzero(np.concatenate([[True], seeds[1:] != seeds[:-1], [True]])) if len(seeds) else np.zeros(1, np.int64)
    found = [np.zeros((0, 2), np.int64)]
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + TOGETHER, side="right")) - 1)
        own = slice(edges[i], edges[j])
        left = padded[(at[own] + reach - 1)[:, None] - x[None, :]]  # words before the seed, the nearest first
        right = padded[(at[own] + reach + seed)[:, None] + x[None, :]]
        s, who, n_left, n_right = seeds[own], k[own], place[own], (end - at)[own] - seed
        hit = np.zeros((len(s), reach + 1), bool)  # by the words a window has before the seed
        y = np.arange(reach + 1)[None, :]
        for d in range(1, int(np.diff(edges[i : j + 1]).max())):
            b = np.flatnonzero((s[d:] == s[:-d]) & (who[d:] > who[:-d])) + d
            a = b - d
            if not len(b) and not (s[d:] == s[:-d]).any():
                break
            most = np.minimum(np.minimum(_matched(left[b], left[a]), n_left[b]), n_left[a])
            after = np.minimum(np.minimum(_matched(right[b], right[a]), n_right[b]), n_right[a])
            hit[b] |= (y <= most[:, None]) & (y >= (reach - after)[:, None])
        r, before = np.nonzero(hit[:, ::-1])
        w = n_left[r] - (reach - before)
        ok = (w >= 0) & (w < n[own][r])
        found.append(np.stack([run[own][r][ok], w[ok]], 1))
        i = j
    return tuple(np.concatenate(found).T)


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Runs of windows (k, at, n, home) whose words also begin in a document with a smaller k; docs: k, text."""
    n = n_parts(docs.sparkSession)

    def seeds(batch):
        ks = batch.column("k").to_numpy()
        for i, _, values, first in _word_values(batch.column("text")):
            s, c, text, at, n_windows, _ = seed_runs(values, first, window, seed)
            yield [s, c, ks[i + text], at.astype(np.int32), n_windows.astype(np.int32)]

    def send(batches):
        for batch in batches:
            ks, runs, out, crowded = batch.column("k").to_numpy(), run_lists(batch), [], []
            for i, j, values, first in _word_values(batch.column("text")):
                own = [r[r[:, 0] + r[:, 1] - 1 + window <= first[x - i + 1] - first[x - i]] for x, r in enumerate(runs[i:j], i)]
                row = np.repeat(np.arange(i, j), [len(r) for r in own])
                if not len(row):
                    continue
                all_ = np.concatenate(own)
                plain = all_[:, 2] >= 0
                if plain.any():
                    at, m, home = all_[plain].T
                    start, k = at + first[row[plain] - i], ks[row[plain]]
                    order = np.argsort(home, kind="stable")
                    edges = np.flatnonzero(np.concatenate([[True], home[order][1:] != home[order][:-1], [True]]))
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        o = order[a:b]
                        words_of = [values[x:y] for x, y in zip(start[o].tolist(), (start + m + window - 1)[o].tolist(), strict=True)]
                        out.append((int(home[o[0]]), RUNS, b"".join([np.int64(len(o)).tobytes(), *(c[o].astype(t).tobytes() for c, t in zip((k, at, m), HEAD, strict=True)), *(w.tobytes() for w in words_of)])))
                if not plain.all():
                    one, two = prefix_sums(values), prefix_sums(mix(values))
                    for x in np.unique(row[~plain]):
                        at, _ = windows_of(own[x - i][own[x - i][:, 2] < 0])
                        g = at + first[x - i]
                        back = powers(BASE_INV, len(values) + 1)[g]
                        crowded.append([as_long(mix((one[g + window] - one[g]) * back)), as_long(mix((two[g + window] - two[g]) * back)), np.full(len(at), ks[x]), at.astype(np.int32), np.ones(len(at), np.int32)])
            yield packs([*out, *(combined(crowded, False, n, last=True) if crowded else [])])

    def meet(batches):
        plain, heads, values = [], [], []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("cols").to_pylist(), strict=True):
                if kind == PLAIN:
                    plain.append(blob)
                elif kind == COPIES:
                    yield from table(SPAN, *_unfolded(*columns([blob])[2:]))
                elif kind == RUNS:
                    m = int(np.frombuffer(blob, np.int64, 1)[0])
                    heads.append(columns([blob[8 : 8 + 16 * m]], HEAD))
                    values.append(np.frombuffer(blob, np.uint64, offset=8 + 16 * m))
        yield from met(plain, [], False, n, last=True)
        if not heads:
            return
        k, at, size = (np.concatenate(c) for c in zip(*heads, strict=True))
        run, w = extended(np.concatenate(values), np.concatenate([[0], np.cumsum(size.astype(np.int64) + window - 1)]), k, window, seed)
        order = np.lexsort((at[run] + w, k[run]))
        k, at = k[run][order], (at[run] + w)[order]
        first, many = stretches(k, at)
        yield from table(SPAN, k[first], at[first], many)

    found = materialise(resolve(docs, seeds, within=False))
    left = per_doc(docs, found.where(F.col("role") != SPAN)).where("runs is not null")
    copies = left.mapInArrow(lean(send), PACKED).repartitionById(n, "bucket").mapInArrow(lean(meet), FOUND)
    return found.where(F.col("role") == SPAN).unionByName(copies.where(F.col("role") == SPAN)).select("k", "at", "n", "home")


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, carry: tuple[str, ...] = (), untouched: bool = False) -> DataFrame:
    """One row per row of documents: doc_id, n_words, n_removed, kept_text, repeats, and the columns in carry.

    A word is removed if a window of `window` words covers it whose words, unchanged, also begin in a document with a
    smaller doc_id. Windows are judged on the input. `repeats` lists the maximal removed stretches (start, end; in words).
    Null or empty text, and text without words: no words, kept_text empty. A null doc_id comes before all others.
    Rows that share a doc_id are one document to this operator: they don't repeat each other, and all are returned.
    Other columns are ignored. kept_text is the words left, joined by one space; if untouched, a text that loses no word
    stays as it is.
    """
    own, kinds = keyed(docs, *carry), dict(docs.dtypes)

    def cut(batches):
        for batch in batches:
            raw, offs = buffers(batch.column("text"))
            data, n_words, n_removed, texts, spans = raw.tobytes(), [], [], [], []
            for r, runs in enumerate(run_lists(batch)):
                w = data[offs[r] : offs[r + 1]].split()
                gone = covered(runs, window, len(w)) if len(runs) else np.zeros(len(w), bool)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                n_words.append(len(w))
                n_removed.append(int(gone.sum()))
                texts.append(data[offs[r] : offs[r + 1]] if untouched and not len(edge) else b" ".join(w if not len(edge) else [w[x] for x in np.flatnonzero(~gone)]))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            yield pa.record_batch([batch.column("k"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), *(batch.column(c) for c in carry)], names=["k", "n_words", "n_removed", "kept_text", "repeats", *carry])

    out = per_doc(own, repeated_spans(own, window, seed)).mapInArrow(lean(cut), "".join(["k long, n_words long, n_removed long, kept_text string, repeats array<struct<start:long,end:long>>", *(f", {c} {kinds[c]}" for c in carry)]))
    return out.select(doc_id(), "n_words", "n_removed", "kept_text", "repeats", *carry)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
