"""What the second rounds of op5 and op8 decide: partial matches, by the suffix sort and by extending seeds."""

import random

import brute
import numpy as np
from pyspark.sql import functions as F

from lociframe.llm import substring_dedup, suffix_dedup, winnow


def mosaic(seed, docs=40, pieces=12):
    """Texts made of shared passages of many lengths in ever other contexts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijé") for _ in range(rng.randint(1, 7)))
    pool = [[word() for _ in range(rng.randint(20, 90))] for _ in range(pieces)]
    out = []
    for i in range(docs):
        w = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(pool)
            a = rng.randint(0, 15)
            w += p[a : len(p) - rng.randint(0, 15)] + [word() for _ in range(rng.randint(0, 30))]
        out.append((i * 7 % docs, " ".join(w)))
    return out


def test_op5_is_decided_by_the_sort(spark):
    no_sort = lambda raw, starts, length: (np.arange(len(starts)), np.zeros(len(starts), bool))
    docs = mosaic(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    cut = lambda **x: sorted(map(tuple, suffix_dedup.remove_repeats(df, **x).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()))
    assert cut() == brute.bytes_removed(docs)
    assert sum(r[2] for r in cut(sort=no_sort)) < 0.8 * sum(r[2] for r in cut())


def test_large_parts_are_split(monkeypatch):
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    raw[2000:2600] = raw[100:700]
    starts = np.arange(0, 2900)
    want = suffix_dedup.sorted_copies(raw, starts, np.zeros(2900, np.int64), starts, 100, suffix_dedup.deep_shallow_sort)
    monkeypatch.setattr(suffix_dedup, "SORT_MOST", 100)
    got = suffix_dedup.sorted_copies(raw, starts, np.zeros(2900, np.int64), starts, 100, suffix_dedup.deep_shallow_sort)
    assert all((a == b).all() for a, b in zip(got, want, strict=True)) and want[0].sum() >= 501


def test_op8_by_extension(spark):
    for seed in (3, 4):
        docs = mosaic(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        got = substring_dedup.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256))
        assert sorted(map(tuple, got.collect())) == brute.words_removed(docs)


def test_extended_against_brute_force():
    rng = np.random.default_rng(5)
    window, seed = 10, 4
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    texts = []
    for _ in range(30):
        t = rng.integers(0, 2**63, 60).astype(np.uint64)
        a, b = sorted(rng.integers(0, 60, 2))
        t[a:b] = base[a:b]
        texts.append(t)
    values, offs = np.concatenate(texts), np.arange(31) * 60
    _, _, text, at, n, _ = winnow.seed_runs(values, offs, window, seed)
    runs = [(int(t), int(a), int(m)) for t, a, m in zip(text, at, n, strict=True)]
    parts = [texts[t][a : a + m + window - 1] for t, a, m in runs]
    k = np.array([t for t, _, _ in runs])
    run, w = substring_dedup.extended(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), k, window, seed)
    got = sorted({(runs[r][0], runs[r][1] + int(x)) for r, x in zip(run, w, strict=True)})
    first = {}
    for t in range(30):
        for i in range(51):
            first.setdefault(texts[t][i : i + window].tobytes(), t)
    assert got == sorted((t, i) for t in range(30) for i in range(51) if first[texts[t][i : i + window].tobytes()] < t)
