"""Best-fit packing of tokenised documents by the sum-of-squares rule."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lociframe.llm.common import IS_SEP, KEPT, as_long, buffers, chunks, doc_id, keyed, lean, materialise, mix, n_parts, word_hashes, words

LENGTH = 2048
GROUP = 4096  # pieces packed together; the waste is under one sequence a group
CACHE = 700_000  # units whose ids a Python worker remembers at most
TOGETHER = 256  # plain units encoded as one text
END_ID = 0


# Kinds of bytes
LETTER, MARK, DIGIT, OTHER = 1, 2, 3, 4
KIND = np.full(256, OTHER, np.uint8)
KIND[IS_SEP] = 0
KIND[33:127] = MARK
KIND[48:58] = DIGIT
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[ord("'")] = OTHER  # the tokenizer joins it with letters


def units(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the units of texts, each text's first, and which are plain: the runs of letters (ASCII and Latin-1),
    digits and ASCII marks of every word, of which letters and marks are plain; a word with anything else is one unit."""
    start, end, _ = words(raw, offs)
    if not len(start):
        return start, end, np.zeros(len(offs), np.int64), np.zeros(0, bool)
    kind = KIND[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    low = raw[lead + 1]
    lead = lead[(low >= 0x80) & (low <= 0xBF) & (low != 0x97) & (low != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    kind[np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))] = OTHER  # may begin a special token
    odd = np.concatenate([[0], np.cumsum(kind == OTHER)])
    whole = odd[end] > odd[start]
    change = np.zeros(len(raw), bool)
    change[1:] = kind[1:] != kind[:-1]
    inside = np.zeros(len(raw) + 1, np.int32)
    np.add.at(inside, start[whole], 1)
    np.add.at(inside, end[whole], -1)
    change &= (np.cumsum(inside)[:-1] == 0) & (kind != 0)
    change[start] = True
    begin = np.flatnonzero(change)
    word = np.searchsorted(start, begin, side="right") - 1
    stop = end[word]
    same = word[1:] == word[:-1]
    stop[:-1][same] = begin[1:][same]
    plain = (kind[begin] == LETTER) | (kind[begin] == MARK)
    return begin, stop, np.searchsorted(begin, offs), plain & ~whole[word]


class WordTokenizer:
    """Token ids of texts, found unit by unit: each distinct unit of a word, letter case aside, is encoded once.

    Fit for tokenizers that lower-case, never join letters, digits, marks or white space with one another, and drop the
    latter, such as word_bpe_49k.json.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, keys: list[int], texts: list[str], plain: bool) -> None:
        """Plain units are runs of letters or marks, one word to the tokenizer each: encoded together, they end where its
        word-end tokens are."""
        encode = lambda x: [e.ids for e in self.tokenizer.encode_batch_fast(x, add_special_tokens=False)]
        flat = size = None
        if plain:
            ids = encode([" ".join(texts[i : i + TOGETHER]) for i in range(0, len(texts), TOGETHER)])
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, sum(map(len, ids)))
            size = np.diff(np.flatnonzero(self.ends[flat]), prepend=-1)
        if size is None or len(size) != len(texts) or size.sum() != len(flat):
            ids = encode(texts)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])

    def __call__(self, text: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        raw, offs = buffers(text)
        for i, j in chunks(offs, 2_000_000):
            part = raw[offs[i] : offs[j]]
            start, end, first, simple = units(part, offs[i : j + 1] - offs[i])
            h = word_hashes(part, start, end, fold=True)
            special = np.flatnonzero((part[start] == ord("<")) & (part[np.minimum(start + 1, len(part) - 1)] == ord("|")))
            if len(special):  # special tokens are in the letter case given
                h[special] = mix(word_hashes(part, start[special], end[special]))
            keys, at, inverse = np.unique(as_long(h), return_index=True, return_inverse=True)
            if len(self.known) > CACHE:
                self.forget()
            data, known, keys = part.tobytes(), self.known, keys.tolist()
            new = np.array([n for n, h in enumerate(keys) if h not in known], np.int64)
            for plain in (True, False):
                some = new[simple[at[new]] == plain]
                spans = zip(start[at[some]].tolist(), end[at[some]].tolist(), strict=True)
                if len(some):
                    self._learn([keys[n] for n in some], [data[x:y].decode() for x, y in spans], plain)
            place = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))[inverse]
            n = self.size[place]
            ends = np.cumsum(n)
            out = self.flat[np.arange(int(n.sum())) + np.repeat(self.begin[place] - ends + n, n)]
            edges = np.concatenate([[0], ends])[first]
            for r in range(i, j):
                yield r, out[edges[r - i] : edges[r - i + 1]]


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a Python worker."""
    return WordTokenizer(path)


KEPT["packing"] = word_tokenizer.cache_clear


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(k, piece, start, length, ids_crc32[, ids]) for docs (k, text): every document's ids and END_ID, cut every `length` ids."""

    def run(batches):
        tokenize = word_tokenizer(tokenizer)
        for batch in batches:
            ks, rows = batch.column("k").to_pylist(), []
            for r, ids in tokenize(batch.column("text")):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for p, at in enumerate(range(0, len(ids), length)):
                    own = ids[at : at + length]
                    rows.append((ks[r], p, at, len(own), zlib.crc32(own.tobytes()), *([own] if with_ids else [])))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.record_batch(cols, names=names)

    names, types = ["k", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    ddl = "k long, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        names, types, ddl = [*names, "ids"], [*types, pa.list_(pa.int32())], ddl + ", ids array<int>"
    return docs.mapInArrow(lean(run, "packing"), ddl)


def sum_of_squares(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size. Sizes are placed from the largest; each goes to the open bin in which it leaves the
    smallest sum of squared counts of open bins per residual gap, and to a new bin only if it fits in none."""
    bins, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    count = np.zeros(length + 1, np.int64)  # open bins by gap; full bins don't count
    open_: list[list[int]] = [[] for _ in range(length + 1)]
    made = 0
    for x in np.argsort(-sizes, kind="stable"):
        s = int(sizes[x])
        before = count[s:length]  # gaps s, s+1, ...
        if before.any():
            change = 2 * (count[: length - s] - before) + 2  # from gap g to gap g - s
            change[0] = 1 - 2 * before[0]  # the bin is full then
            change[before == 0] = 2**62
            gap = s + int(change.argmin())
            b = open_[gap].pop()
            count[gap] -= 1
        else:
            gap, b = length, made
            made += 1
        bins[x], offset[x] = b, length - gap
        if gap > s:
            open_[gap - s].append(b)
            count[gap - s] += 1
    return bins, offset


def place(cut: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """cut (k, piece, length, ...; materialised) with sequence_id and offset: pieces of full length have their own
    sequence; the others are dealt by hash into groups of about `group` pieces, and each group is packed by itself.
    A group's number of pieces does not grow with the corpus; the number of groups does."""
    spark = cut.sparkSession
    n = max(1, cut.where(F.col("length") < length).count() // group)
    tasks = min(n, n_parts(spark))
    numbered = cut.withColumn("g", F.when(F.col("length") < length, F.pmod(F.xxhash64("k", "piece"), F.lit(n)).cast("int")))

    def run(batches):
        rows = pa.Table.from_batches(batches)
        if not rows.num_rows:
            return
        g = rows.column("g").to_numpy()
        order = np.lexsort((rows.column("piece").to_numpy(), rows.column("k").to_numpy(), g))
        rows, g = rows.take(pa.array(order)), g[order]
        sizes = rows.column("length").to_numpy()
        edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        seq, off = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            bins, off[a:b] = sum_of_squares(sizes[a:b], length)
            seq[a:b] = g[a].astype(np.int64) * 2**24 + bins
        yield from rows.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off)).to_batches()

    schema = StructType([*numbered.schema.fields]).add("sequence_id", "long").add("offset", "long")
    packed = numbered.where("g is not null").withColumn("t", F.col("g") % tasks).repartitionById(tasks, "t").drop("t").mapInArrow(lean(run, "packing"), schema).drop("g")
    full = numbered.where("g is null").drop("g").withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the one id END_ID. Rows that share a doc_id are packed each. A null doc_id stays null.
    An empty table gives no rows. Other columns are ignored.
    """
    placed = place(materialise(pieces(keyed(docs), tokenizer, length)), length, group)
    return placed.select(doc_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer("word_bpe_49k.json"))
