"""Rule bitmask ledger: measure every text once, store measurements and one failure bit per rule, then apply versioned
policies and compute ablations on the bits alone."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import BASE, buffers, chunks, doc_id, keyed, lean, mix, span_hashes, word_hashes, words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals", "n_bangs", "n_unspaced"]
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


# Code points of scripts that put no space between words: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED = [(0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)]
IS_LETTER, IS_CAPITAL, IS_UNSPACED = 1, 2, 4


class Classes:
    """Of every code point: whether it is a letter, a capital letter, a letter of a script without spaces."""

    def __init__(self):
        self.table = np.full(0x110000, 255, np.uint8)

    def __call__(self, raw: bytes) -> np.ndarray:
        code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.table[code]
        if (out == 255).any():
            for x in np.unique(code[out == 255]).tolist():
                kind = unicodedata.category(chr(x))
                letter = kind[0] == "L"
                self.table[x] = IS_LETTER * letter + IS_CAPITAL * (kind == "Lu") + IS_UNSPACED * (letter and any(a <= x <= b for a, b in UNSPACED))
            out = self.table[code]
        return out


def c(name: str) -> Column:
    return F.col(name)


def rules() -> list[tuple[str, Column]]:
    """Name and failure condition over the measurements. A rule's bit is its place here: the order is part of a stored
    ledger, so rules are only ever added at the end."""
    return [
        ("few_words", c("n_words") < 50),
        ("repeated_words", 100 * c("n_repeat_words") > 50 * c("n_words")),
        ("symbols", 100 * c("n_symbols") > 20 * c("n_words")),
        ("duplicate_lines", (c("n_dup_lines") > 2) & (100 * c("n_dup_lines") > 30 * c("n_lines"))),
        ("capitals", 100 * c("n_capitals") > 50 * c("n_letters")),
        ("exclamations", 100 * c("n_bangs") > 50 * c("n_words")),
        ("long_words", c("word_chars") - c("n_unspaced") > 20 * c("n_words")),
        ("short_words", 10 * c("word_chars") < 20 * c("n_words")),
        ("no_letters", 100 * c("n_letters") < 25 * c("word_chars")),
    ]


#: Policies by version: the rules a document must not fail. A version never changes once it is published.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "duplicate_lines", "capitals", "exclamations", "long_words", "short_words", "no_letters"],
}


def mask(names: list[str]) -> int:
    place = {name: i for i, (name, _) in enumerate(rules())}
    return sum(1 << place[x] for x in names)


def measured(docs: DataFrame) -> DataFrame:
    """docs (k, text) with the measurements."""

    def run(batches):
        classes = Classes()
        for batch in batches:
            raw, offs = buffers(batch.column("text"))
            got = [np.zeros((j - i, len(MEASURES)), np.int64) for i, j in chunks(offs)] or [np.zeros((0, len(MEASURES)), np.int64)]
            for out, (i, j) in zip(got, chunks(offs), strict=False):
                part, at = raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])  # noqa: E731, B023
                start, end, first = words(part, at)
                chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                in_words = np.concatenate([[0], np.cumsum(chars[end] - chars[start])])
                kind = classes(part.tobytes())
                of = lambda bit: np.diff(np.concatenate([[0], np.cumsum((kind & bit) != 0)])[chars[at]])  # noqa: E731, B023
                out[:, 0], out[:, 1], out[:, 2] = np.diff(first), np.diff(in_words[first]), per_text(SYMBOL[part])
                out[:, 6], out[:, 7], out[:, 8], out[:, 9] = of(IS_LETTER), of(IS_CAPITAL), per_text(part == 33), of(IS_UNSPACED)
                out[:, 3], out[:, 4] = _lines(part, at, start)
                out[:, 5] = _repeats(word_hashes(part, start, end), first)
            table = np.concatenate(got)
            yield pa.record_batch([batch.column("k"), *(pa.array(table[:, m]) for m in range(len(MEASURES)))], names=["k", *MEASURES])

    return docs.mapInArrow(lean(run), "k long, " + ", ".join(f"{m} long" for m in MEASURES))


def _later(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier entry of the same text."""
    order = np.lexsort((key, text))
    k, t = key[order], text[order]
    again = np.zeros(len(key), bool)
    again[order[1:]] = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    return again


def _lines(raw: np.ndarray, offs: np.ndarray, word_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line, of each text."""
    breaks = np.flatnonzero(raw == 10)
    start = np.union1d(offs[:-1], breaks + 1)
    start = start[start < len(raw)]
    if not len(start):
        return np.zeros(len(offs) - 1, np.int64), np.zeros(len(offs) - 1, np.int64)
    end = np.append(start[1:], len(raw))
    end = end - (raw[end - 1] == 10)
    text = np.searchsorted(offs, start, side="right") - 1
    has = np.searchsorted(word_start, end) > np.searchsorted(word_start, start)
    start, end, text = start[has], end[has], text[has]
    again = _later(span_hashes(raw, start, end), text)
    n = len(offs) - 1
    return np.bincount(text, minlength=n), np.bincount(text, weights=again, minlength=n).astype(np.int64)


def _repeats(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words in 3-word windows that their text has twice or more."""
    count = np.maximum(np.diff(first) - 2, 0)
    text = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    if not len(at):
        return np.zeros(len(count), np.int64)
    key = mix((mix(h[at]) * BASE + h[at + 1]) * BASE + h[at + 2])
    order = np.lexsort((key, text))
    k, t = key[order], text[order]
    same = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order[twice]]
    covered = np.zeros(len(h), np.int64)
    for d in range(3):
        covered[hit + d] = 1
    return np.diff(np.concatenate([[0], np.cumsum(covered)])[first])


def ledger(docs: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, the measurements, and failed, a bit for each rule failed.

    Null or empty text has zero for every measurement and fails few_words. Rows that share a doc_id are judged each.
    Columns other than doc_id and text are ignored.
    """
    bits = [F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, failed) in enumerate(rules())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured(keyed(docs)).select(doc_id(), *MEASURES, failed.alias("failed"))


def passes(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """For every rule of a policy: documents that fail it, and those that fail it alone, so would stay without it."""
    enforced = mask(POLICIES[policy])
    failed = F.col("failed").bitwiseAND(F.lit(enforced))
    sums = []
    for i, (name, _) in enumerate(rules()):
        if enforced >> i & 1:
            bit = F.lit(1 << i)
            sums += [F.struct(F.lit(name).alias("rule"), F.count_if(failed.bitwiseAND(bit) != 0).alias("n_failed"), F.count_if(failed == bit).alias("n_alone"))]
    return book.agg(F.array(*sums).alias("all")).select(F.inline("all"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), "failed")
