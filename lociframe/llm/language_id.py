"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lociframe.llm.common import NO_ID, buffers, chunks, keyed, lean

ORDERS = (1, 2, 3)  # n-gram lengths; a gram is packed into 21 bits a character
PROFILE = 1000  # n-grams of a language profile
TOP = 400  # n-grams of a document that are ranked
PARTS = 64  # in which a language's n-grams are ranked first
SAMPLE = 5000  # documents per language that profiles are learned from, about
UNKNOWN = "und"


class Letters:
    """Maps code points to lower-case letters, and anything else to 0, which separates words."""

    def __init__(self):
        self.table = np.full(0x110000, -1, np.int32)

    def __call__(self, text: bytes) -> np.ndarray:
        code = np.frombuffer(text.decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.table[code]
        if (out < 0).any():
            for x in np.unique(code[out < 0]).tolist():
                low = chr(x).lower()
                self.table[x] = ord(low[0]) if chr(x).isalpha() else 0
            out = self.table[code]
        return out.astype(np.int64)


def grams(letters: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of letters, padded with one separator on both sides of a word, and the text of each."""
    out, of = [], []
    g = letters
    for n in ORDERS:
        if n > 1:
            g = (g[:-1] << 21) | letters[n - 1 :]
        first, last = letters[: len(g)], letters[n - 1 :]
        inner = np.ones(len(g), bool) if n < 3 else letters[1 : len(g) + 1] != 0
        ok = inner & ((first != 0) | (last != 0)) & (text[: len(g)] == text[n - 1 :]) if n > 1 else letters != 0
        out.append(g[ok])
        of.append(text[: len(g)][ok])
    return np.concatenate(out), np.concatenate(of)


def letter_runs(batch: pa.RecordBatch, letters: Letters):
    """For row ranges (i, j): the letters of the texts, with a separator before and after each, and the text of each."""
    raw, offs = buffers(batch.column("text"))
    for i, j in chunks(offs, 1_000_000):
        data = raw[offs[i] : offs[j]].tobytes()
        parts = [letters(data[offs[r] - offs[i] : offs[r + 1] - offs[i]]) for r in range(i, j)]
        size = np.array([len(p) + 2 for p in parts])
        flat = np.zeros(size.sum(), np.int64)
        for p, at in zip(parts, np.cumsum(size) - size, strict=True):
            flat[at + 1 : at + 1 + len(p)] = p
        yield i, j, flat, np.repeat(np.arange(j - i), size)


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def learn(docs: DataFrame, profile: int = PROFILE, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Each language's most frequent n-grams, most frequent first, from documents (k, text, lang).

    About `sample` documents of each language are used, chosen by a hash of their id and text, so that of a text that many
    documents have each is chosen by itself. The result is as large as profile x languages.
    """
    docs = docs.where("lang is not null and text is not null")
    sizes = docs.groupBy("lang").count().select(F.col("lang").alias("of"), F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count")).alias("share"))
    # one row a language, as the profiles that every task gets anyway: broadcast, so that no text moves
    chosen = docs.join(F.broadcast(sizes), F.col("lang") == F.col("of")).where(F.pmod(F.xxhash64("k", "text"), F.lit(1_000_003)) < F.col("share") * 1_000_003).select("text", "lang")

    def count(batches):
        letters = Letters()
        for batch in batches:
            langs, lang = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            for i, _, flat, text in letter_runs(batch, letters):
                g, of = grams(flat, text)
                for x in np.unique(lang[of + i]):
                    keys, n = np.unique(g[lang[of + i] == x], return_counts=True)
                    yield pa.record_batch([pa.array([langs[x]] * len(keys)), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])

    counted = chosen.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the first of each part of a language's n-grams, then the first of those
    part = F.pmod("gram", F.lit(PARTS))
    for by in (["lang", part], ["lang"]):
        counted = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= profile)
    ranked = counted
    out: dict[str, list] = {}
    for lang, gram, _ in sorted(ranked.select("lang", "gram", "rank").collect(), key=lambda r: (r[0], r[2])):
        out.setdefault(lang, []).append(gram)
    return {lang: np.array(g, np.int64) for lang, g in out.items()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], into: str, top: int = TOP) -> DataFrame:
    """docs (text, ...) with a column `into`: a struct of lang_pred and score.

    A document's n-grams that are in any profile are ranked by frequency, ties by the n-gram; its `top` first are
    compared. A gram's distance to a language is the difference of its two ranks, or the profile's length where the
    profile lacks it; n-grams in no profile cost every language the same and are left out. The least sum wins, ties go to
    the first language by name. score is 1 - distance / (profile length x grams compared).
    """
    names = sorted(profiles)
    vocabulary = np.unique(np.concatenate([profiles[x] for x in names])) if names else np.zeros(0, np.int64)
    longest = max((len(profiles[x]) for x in names), default=1)
    ranks = np.full((len(names), len(vocabulary)), longest, np.int64)
    for i, x in enumerate(names):
        ranks[i, np.searchsorted(vocabulary, profiles[x])] = np.arange(len(profiles[x]))
    missing = ranks >= longest
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, ranks, missing))
    bits = 20

    def run(batches):
        vocabulary, ranks, missing = shared.value
        letters = Letters()
        slot = lambda g: ((g * np.int64(0x9E3779B97F4A7C1)) >> np.int64(64 - bits - 8)) & np.int64((1 << bits) - 1)
        table = np.full(1 << bits, len(vocabulary), np.int32)
        home = slot(vocabulary)
        table[home] = np.arange(len(vocabulary))
        lost = table[home] != np.arange(len(vocabulary))  # slots taken by another gram: looked up apart
        rest, rest_id = vocabulary[lost], np.flatnonzero(lost)
        padded = np.append(vocabulary, -1)
        for batch in batches:
            preds, scores = [], []
            for i, j, flat, text in letter_runs(batch, letters):
                g, of = grams(flat, text)
                idx = table[slot(g)]
                idx[padded[idx] != g] = len(vocabulary)
                if len(rest):
                    at = np.minimum(np.searchsorted(rest, g), len(rest) - 1)
                    idx = np.where(rest[at] == g, rest_id[at], idx)
                any_letter = np.bincount(text, weights=flat != 0, minlength=j - i) > 0
                known = idx < len(vocabulary)
                width = len(vocabulary)
                key, n = np.unique(of[known] * width + idx[known], return_counts=True) if known.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                row, gram = key // max(width, 1), key % max(width, 1)
                order = np.lexsort((gram, -n, row))
                row, gram = row[order], gram[order]
                edges = np.searchsorted(row, np.arange(j - i + 1))
                for r in range(j - i):
                    own = gram[edges[r] : min(edges[r + 1], edges[r] + top)]
                    if not any_letter[r] or not len(ranks):
                        preds.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    d = np.where(missing[:, own], longest, np.abs(ranks[:, own] - np.arange(len(own)))).sum(1) if len(own) else np.full(len(ranks), longest)
                    best = int(d.argmin())
                    preds.append(names[best])
                    scores.append(float(1 - min(1.0, d[best] / (longest * max(len(own), 1)))))
            found = pa.StructArray.from_arrays([pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, into])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields]).add(into, StructType().add("lang_pred", "string").add("score", "double")))


def label_languages(docs: DataFrame, profile: int = PROFILE, top: int = TOP, sample: int = SAMPLE) -> tuple[DataFrame, str]:
    """docs with one more column, a struct of lang_pred and score, and that column's name, which is none of docs' own; see
    identify. text and lang are read, other columns pass through."""
    into = "language"
    while into in {c.lower() for c in docs.columns}:
        into += "_"
    train = keyed(docs, "lang").where((F.col("k") != NO_ID) & ~held_out(F.col("k")))
    return predict(docs, learn(train.select("k", "text", "lang"), profile, sample), into, top), into


def identify(docs: DataFrame, profile: int = PROFILE, top: int = TOP, sample: int = SAMPLE) -> DataFrame:
    """One row per row of documents: doc_id, held_out, lang_pred, score.

    Profiles are learned from rows with text and lang whose crc32(doc_id as text) mod 5 is not 0. A text that is null or has
    no letter gets `und` and score 0, as does every text if nothing could be learned. A null doc_id is never held out and
    never learned from. Rows that share a doc_id are predicted each. Other columns are ignored.
    """
    rows, of = label_languages(docs.select("doc_id", "text", "lang"), profile, top, sample)
    return rows.select("doc_id", (F.col("doc_id").isNotNull() & held_out(F.col("doc_id"))).alias("held_out"), f"{of}.lang_pred", f"{of}.score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
