"""Periodic runs of words in documents, by online dyadic square catching.

Words are appended to a stream. Every completed block of 2^j words, aligned to its length, is a catcher: a run of period q
and exponent e at least has (e - 1) * q words that equal the word q further on, and any stretch of 2 * 2^j - 1 words holds a
whole block. So level j watches the periods with 2 * 2^j - 1 <= (e - 1) * q < 4 * 2^j - 1, and each appended word compares
the stream's suffix of 2^j words with the one or two blocks of the level at such a distance. An equal block is extended
both ways, word by word, into the stretch in which words q apart are equal; a stretch that reaches the stream's end stays
open, and the words appended next advance it. Stretches of q words and more are squares, merged into their run.
Levels compare by hash, extension by the words' numbers, so a hash collision costs time and changes nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import BASE, doc_id, keyed, lean, mix

EXPONENT, SHORTEST = 4, 6
GROUP = 200_000  # words of documents that go through one stream, or one longer document: bounds a task's memory
FOUND = "k long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.room, self.n = np.zeros(256, kind), 0

    def extend(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(self.n + 2 * len(x), self.room.dtype)])
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


class Catchers:
    """The catchers of one stream. Words are numbers; `longest` bounds the words between separators, if it is known."""

    def __init__(self, exponent: int = 2, shortest: int = 2, longest: int | None = None):
        if exponent < 2:
            raise ValueError("a run holds its period twice at least")
        self.exponent, self.shortest, self.longest = exponent, shortest, longest
        self.words = Growing(np.int64)
        self.levels: list[Growing] = []  # of level j, a hash for every suffix of 2^j words so far, by its first word
        self.open: dict[int, tuple[int, int]] = {}  # by period, the stretch [a, z) that the next word may prolong
        self.squares: list[tuple[int, int, int]] = []  # closed stretches of a period's length at least: a, z, period

    def append(self, words: np.ndarray) -> None:
        """Words that come next: one, or any number at once with the same result."""
        self.words.extend(words)
        for q, (a, z) in list(self.open.items()):
            self._keep(q, a, self._right(z, q))
        j = 0
        while self.exponent * self._least(j) <= min(self.words.n, self.longest or self.words.n):
            if j == len(self.levels):
                self.levels.append(Growing(np.uint64))
            self._advance(j)
            j += 1

    def runs(self) -> np.ndarray:
        """Rows of start, length and smallest period, for every run so far of the wanted exponent and length."""
        found = np.array([*self.squares, *((a, z, q) for q, (a, z) in self.open.items())], np.int64).reshape(-1, 3)
        a, n, q = found[:, 0], found[:, 1] - found[:, 0] + found[:, 2], found[:, 2]
        long = n >= np.maximum(self.shortest, self.exponent * q)
        a, n, q = a[long], n[long], q[long]
        order = np.lexsort((q, n, a))
        a, n, q = a[order], n[order], q[order]
        first = np.ones(len(a), bool)  # the same stretch with a multiple of its period comes after it
        first[1:] = (a[1:] != a[:-1]) | (n[1:] != n[:-1])
        out = np.stack([a, n, q], axis=1)[first]
        return out[np.lexsort((out[:, 2], out[:, 0]))]

    def _least(self, j: int) -> int:
        return -(-(2 * 2**j - 1) // (self.exponent - 1))

    def _advance(self, j: int) -> None:
        """Hash the new suffixes of 2^j words and compare them with the level's catchers."""
        s, level = 2**j, self.levels[j]
        p = np.arange(level.n, max(level.n, self.words.n - s + 1))
        if not len(p):
            return
        if j == 0:
            level.extend(mix(self.words.all[p].view(np.uint64) + BASE))
        else:
            half = self.levels[j - 1].all
            level.extend(mix(mix(half[p[0] : p[-1] + 1]) * BASE + half[p[0] + s // 2 : p[-1] + 1 + s // 2]))
        least, most = self._least(j), (4 * s - 2) // (self.exponent - 1)
        h, new, hits = level.all, level.all[p[0] :], []
        b = (p - least) // s * s
        while True:
            near = (b >= 0) & (p - b <= most)
            if not near.any():
                break
            same = near & (h[np.maximum(b, 0)] == new)
            hits.append(np.stack([b[same], p[same]], axis=1))
            b = b - s
        hits = np.concatenate(hits) if hits else np.zeros((0, 2), np.int64)
        if len(hits):
            self._catch(hits[:, 0], hits[:, 1] - hits[:, 0], s)

    def _catch(self, b: np.ndarray, q: np.ndarray, s: int) -> None:
        """Extend the equal blocks at b and b + q. Those inside a run of a period up to s have its period's multiple, or none
        that is smallest: two runs share less than the sum of their periods."""
        known = np.array([(a, z + p) for a, z, p in [*self.squares, *((a, z, p) for p, (a, z) in self.open.items() if z - a >= p)] if p <= s], np.int64).reshape(-1, 2)
        if len(known):
            known = known[np.argsort(known[:, 0])]
            i = np.searchsorted(known[:, 0], b, side="right") - 1
            covered = (i >= 0) & (np.maximum.accumulate(known[:, 1])[np.maximum(i, 0)] >= b + q + s)
            b, q = b[~covered], q[~covered]
        order = np.lexsort((b, q))
        b, q = b[order], q[order]
        at = 0
        while at < len(b):
            period = int(q[at])
            end = int(np.searchsorted(q, period, side="right"))
            while at < end:
                a, z = self.open.get(period, (0, 0))
                if not a <= b[at] < z:
                    a, z = self._left(int(b[at]), period), self._right(int(b[at]) + s, period)
                    self._keep(period, a, z)
                at += int(np.searchsorted(b[at:end], z))

    def _keep(self, q: int, a: int, z: int) -> None:
        if z + q == self.words.n:
            self.open[q] = a, z
            return
        if self.open.get(q, (None, None))[0] == a:
            del self.open[q]
        if z - a >= q:
            self.squares.append((a, z, q))

    def _right(self, i: int, q: int) -> int:
        """The first place from i whose word differs from the one q further on, or has none there."""
        w, step = self.words.all, 64
        while i + q < len(w):
            x, y = w[i : i + step], w[i + q : i + q + step]
            if (unlike := x[: len(y)] != y).any():
                return i + int(unlike.argmax())
            i, step = i + len(y), 2 * step
        return i

    def _left(self, i: int, q: int) -> int:
        """The first place from which up to i all words equal the one q further on."""
        w, step = self.words.all, 64
        while i > 0:
            x, y = w[max(0, i - step) : i][::-1], w[max(0, i - step) + q : i + q][::-1]
            if (unlike := x != y).any():
                return i - int(unlike.argmax())
            i, step = i - len(x), 2 * step
        return i


def _grouped(texts: Iterable[str], most: int = GROUP):
    """Ranges of rows with `most` words together, or one row: the first row's number, and each row's words."""
    first, held, n = 0, [], 0
    for i, text in enumerate(texts):
        words = text.encode().split()  # at exactly the bytes 20 and 09 to 0D
        if held and n + len(words) > most:
            yield first, held
            first, held, n = i, [], 0
        held.append(words)
        n += len(words)
    if held:
        yield first, held


def _runs_of(held: list[list[bytes]], exponent: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of each text's words, as rows of text, start, length and period, and where each text's runs begin."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes = np.array([len(w) for w in held])
    begin = np.cumsum(sizes + 1) - sizes - 1
    stream = np.full(int(sizes.sum()) + len(held), -1, np.int64)
    for at, w in zip(begin, held, strict=True):
        stream[at : at + len(w)] = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
    stream[begin + sizes] = -1 - np.arange(len(held))  # separators, each equal to nothing
    catchers = Catchers(exponent, shortest, int(sizes.max()))
    catchers.append(stream)
    found = catchers.runs()
    text = np.searchsorted(begin, found[:, 0], side="right") - 1
    found[:, 0] -= begin[text]
    return found, np.searchsorted(text, np.arange(len(held) + 1))


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, of each run only its first period."""
    if len(runs):
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
        words = [w for w, n in zip(words, np.cumsum(edges[:-1]).tolist(), strict=True) if not n]
    return b" ".join(words)


def word_runs(docs: DataFrame, exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """One row per row of documents: doc_id, n_words, runs (array of start, length, period, by start, then period) and
    collapsed, the text without the repetitions of its runs.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text. A run is a stretch with smallest period `period` of at least
    max(shortest, exponent * period) words that cannot be prolonged. A word goes from collapsed if some run contains it after
    that run's first period. A null or empty text has no words, no runs and an empty collapsed text. Rows that share a doc_id
    are judged each, as nothing crosses rows. Other columns are ignored. No row is shuffled.
    """

    def run(batches):
        for batch in batches:
            ks, texts = batch.column("k"), batch.column("text")
            for first, held in _grouped(t.as_py() for t in texts):
                found, cut = _runs_of(held, exponent, shortest)
                inner = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in range(3)], ["start", "length", "period"])
                out = [collapsed(w, found[cut[i] : cut[i + 1]]).decode() for i, w in enumerate(held)]
                yield pa.record_batch([ks.slice(first, len(held)), pa.array([len(w) for w in held], pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), inner), pa.array(out, pa.string())], names=["k", "n_words", "runs", "collapsed"])

    return keyed(docs).mapInArrow(lean(run), FOUND).select(doc_id(), "n_words", "runs", "collapsed")


def longest_by_period(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones the first. Null without runs."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def made_periodic(docs: DataFrame) -> DataFrame:
    """documents with the words of a tenth of them, by the checksum of doc_id, repeated from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("__w"), g.alias("__g"))
    n = F.size("__w")
    rows = rows.withColumn("__a", F.when(n > 0, F.col("__g") % n)).withColumn("__p", 1 + F.floor((n - F.col("__a")) / (3 + F.col("__g") % 8)))
    a, p, w = F.col("__a"), F.col("__p"), F.col("__w")
    again = F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))
    return rows.select("doc_id", F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    best, line = longest_by_period(F.col("runs")), lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    rows = word_runs(made_periodic(docs)).withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
