"""Shared pieces of the training-data operators: scratch tables, keys, and batch-wise text hashing with numpy."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(2**63)  # stands for a null doc_id; it sorts before every other


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or else the context's checkpoint directory, which all executors share.
    Without either, a local master uses /tmp/checkpoints; a cluster has to name one."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        own = sc._jsc.sc().getCheckpointDir()
        top = own.get() if own.isDefined() else None
    if not top:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "/tmp/checkpoints"
    path = f"{top.rstrip('/')}/lociframe-{uuid.uuid4().hex}"
    p, fs = _folder(spark, path)
    fs.deleteOnExit(p)
    return path


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialise(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back: a lost executor costs no recomputation.
    The folder goes when the JVM ends, or earlier by `discard` if `made` is given, a list to which its path is added."""
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    while made:
        p, fs = _folder(spark, made.pop())
        fs.delete(p, True)


#: By owner, what empties the tables that a Python worker keeps from one task to the next.
KEPT: dict[str, Callable[[], None]] = {}


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, so that workers, which Spark uses again and again, hold no memory between tasks: other owners'
    tables go before, and free memory goes back to the system after."""

    @functools.wraps(run)
    def body(batches):
        empty_others(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return body


def empty_others(owner: str) -> None:
    for name, empty in KEPT.items():
        if name != owner:
            empty()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only glibc has it


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as a non-null long `k`, the text with null as empty, and the columns named."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def doc_id(k: str = "k"):
    return F.nullif(F.col(k), F.lit(NO_ID)).alias("doc_id")


# --- numpy over batches of texts -------------------------------------------------------------------------------------

CHUNK = 3_000_000  # bytes of text hashed at once: bounds the memory of a task whatever the batch holds
_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
IS_SEP = np.zeros(256, bool)
IS_SEP[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row's bytes begin (one more entry than rows)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = col.buffers()
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(offs: np.ndarray, most: int = CHUNK):
    """Row ranges (i, j) of at most `most` bytes each, or of one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, j
        i = j


SHORT = 64  # bytes of a span up to which it is hashed with all others at once
LAST = np.array([0, *((1 << 8 * n) - 1 for n in range(1, 8)), 2**64 - 1], np.uint64)  # keeps the first n bytes of eight


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each [start, end). Eight bytes at a time are mixed into what came before, so that no pair of texts
    collides by its form, as pairs do under a polynomial modulo a power of two."""
    n = end - start
    h = mix(n.astype(np.uint64) + BASE)
    eight = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    for at in range(0, SHORT, 8):
        some = np.flatnonzero((n > at) & (n <= SHORT))
        if not len(some):
            break
        h[some] = mix((h[some] ^ (eight[start[some] + at] & LAST[np.minimum(n[some] - at, 8)])) + BASE)
    for i in np.flatnonzero(n > SHORT).tolist():
        h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(raw[start[i] : end[i]]))
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word [^\\x20\\x09-\\x0D]+, and each row's first word (one more entry than rows)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    sep = IS_SEP[raw]
    before, after = np.empty(len(raw), bool), np.empty(len(raw), bool)
    before[0], before[1:], after[-1], after[:-1] = True, sep[:-1], True, sep[1:]
    before[offs[:-1][offs[:-1] < len(raw)]] = True
    after[offs[1:][offs[1:] > 0] - 1] = True
    start, end = np.flatnonzero(~sep & before), np.flatnonzero(~sep & after) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    return span_hashes(LOWER[raw] if fold else raw, start, end)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
