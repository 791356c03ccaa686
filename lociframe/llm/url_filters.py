"""URL filters over a sorted digest array.

The rules of a filter list are strings of three kinds: hosts with a path prefix ("example.org/en/"), hosts alone, which fit
any path, and words of host names. All are kept in one file: 64-bit xxhash keys, sorted, then where each entry's full
string begins, what it decides, and the strings. Executors fetch the file once and map it into memory, so that all workers of
a machine share its pages. A batch of urls is probed by binary search over all its candidate strings at once, and
an entry counts only if its stored string is the candidate, so that equal keys of different strings decide nothing.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import _folder, buffers, lean, scratch_dir

#: Entries that a list may have to be sent to every executor, some 100 bytes each; a longer one is joined instead.
MOST_ENTRIES = 20_000_000
SEED = 42  # Spark's own xxhash64 has it
ALLOW, BLOCK, DEFAULT = "allow", "block", "allow"
#: Host names with one of these words, between dots and hyphens, are blocked where no rule decides.
WORDS = ("ads", "adult", "bet", "bets", "betting", "casino", "escort", "gambling", "hookup", "loans", "payday", "pharmacy", "pills", "poker", "porn", "replica", "sex", "slots", "torrent", "tracker", "viagra", "warez", "xxx")
#: Verdict, host and path of the rules of op13.
RULES = ((ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"), (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/"))
HOST, WORD, RULE = "h", "w", "r"  # first letter of a stored string: a host that has rules, a word, a rule
VERDICTS = (ALLOW, BLOCK)


def entries(rules: DataFrame, words: Iterable[str] = WORDS) -> DataFrame:
    """The entries of a list. rules: verdict, host (any case) and path, a prefix; null or empty fits every path. Rows with a
    null host or verdict say nothing. Of rules for one host and path that disagree, block counts.

    entry (string), verdict (0 allow, 1 block; null for hosts) and lengths, for hosts: of the paths of their rules."""
    r = rules.where("host is not null and verdict is not null")
    r = r.select(lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), (F.col("verdict") == BLOCK).cast("int").alias("v"))
    r = r.groupBy("host", "path").agg(F.max("v").alias("verdict"))
    hosts = r.groupBy("host").agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"))
    bad = rules.sparkSession.createDataFrame([(w.lower(),) for w in dict.fromkeys(words)], "w string")
    return (
        r.select(F.concat(F.lit(RULE), "host", "path").alias("entry"), "verdict", F.expr("cast(null as array<int>)").alias("lengths"))
        .unionByName(hosts.select(F.concat(F.lit(HOST), "host").alias("entry"), F.lit(None).cast("int").alias("verdict"), "lengths"))
        .unionByName(bad.select(F.concat(F.lit(WORD), "w").alias("entry"), F.lit(1).alias("verdict"), F.expr("cast(null as array<int>)").alias("lengths")))
    )


def lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class DigestArray:
    """Sorted keys and the entries behind them. `bits` shortens keys, so that tests have collisions."""

    PARTS = (("keys", np.uint64), ("at", np.int64), ("verdict", np.int8), ("lengths_at", np.int64), ("lengths", np.int32), ("strings", np.uint8))

    def __init__(self, bits: int, **parts: np.ndarray):
        self.bits = bits
        self.keys, self.at, self.verdict, self.lengths_at, self.lengths, self.strings = (parts[name] for name, _ in self.PARTS)

    @classmethod
    def made(cls, table: pa.Table, bits: int = 64) -> DigestArray:
        found = table.column("entry").combine_chunks()
        keys = hashed([s.as_py().encode() for s in found], bits)
        order = np.argsort(keys, kind="stable")
        raw, at = buffers(found.take(pa.array(order)))
        lengths = table.column("lengths").combine_chunks().take(pa.array(order))
        sizes = pc.fill_null(pc.list_value_length(lengths), 0).to_numpy(zero_copy_only=False)
        verdict = pc.fill_null(table.column("verdict").combine_chunks(), -1).take(pa.array(order)).to_numpy(zero_copy_only=False)
        return cls(bits, keys=keys[order], at=at, verdict=verdict.astype(np.int8), lengths_at=np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), lengths=lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int32), strings=raw)

    def pieces(self):
        """The file: sizes of the parts, then the parts, each from a multiple of 8 bytes."""
        parts = [np.ascontiguousarray(getattr(self, name), kind) for name, kind in self.PARTS]
        yield np.array([self.bits, *map(len, parts)], np.int64).tobytes()
        for p in parts:
            yield p.tobytes() + bytes(-p.nbytes % 8)

    @classmethod
    def mapped(cls, path: str) -> DigestArray:
        whole = np.memmap(path, np.uint8, "r")
        head, begin, parts = whole[: 8 * (1 + len(cls.PARTS))].view(np.int64), 8 * (1 + len(cls.PARTS)), {}
        for (name, kind), n in zip(cls.PARTS, head[1:].tolist(), strict=True):
            size = n * np.dtype(kind).itemsize
            parts[name] = whole[begin : begin + size].view(kind)
            begin += size + -size % 8
        return cls(int(head[0]), **parts)

    def find(self, probes: list[bytes]) -> np.ndarray:
        """The entry of each probe, or -1."""
        out = np.full(len(probes), -1, np.int64)
        if not probes or not len(self.keys):
            return out
        keys = hashed(probes, self.bits)
        first, last = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for i in np.flatnonzero(last > first).tolist():
            for e in range(first[i], last[i]):  # several only if keys of different strings collide
                if self.strings[self.at[e] : self.at[e + 1]].tobytes() == probes[i]:
                    out[i] = e
        return out

    def lengths_of(self, entry: int) -> list[int]:
        return self.lengths[self.lengths_at[entry] : self.lengths_at[entry + 1]].tolist()


def hashed(strings: list[bytes], bits: int) -> np.ndarray:
    keys = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in strings), np.uint64, len(strings))
    return keys >> np.uint64(64 - bits) if bits < 64 else keys


def suffixes(host: str) -> list[str]:
    """host and the domains above it, the longest first."""
    cuts = [0, *(i + 1 for i, c in enumerate(host) if c == ".")]
    return [host[i:] for i in cuts]


def host_words(host: str) -> list[str]:
    return [w for w in host.replace("-", ".").split(".") if w]


def judged(array: DigestArray, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
    """Rule and verdict of every url: of its rules the longest, of equal ones that of the longer host; else by words."""
    number = {h: i for i, h in enumerate(dict.fromkeys(hosts))}
    parents = [suffixes(h) for h in number]
    flat = list(dict.fromkeys(itertools.chain.from_iterable(parents)))
    known = {d: array.lengths_of(e) for d, e in zip(flat, array.find([f"{HOST}{d}".encode() for d in flat]).tolist(), strict=True) if e >= 0}
    named = [host_words(h) for h in number]
    flat = list(dict.fromkeys(itertools.chain.from_iterable(named)))
    bad = {w for w, e in zip(flat, array.find([f"{WORD}{w}".encode() for w in flat]).tolist(), strict=True) if e >= 0}
    blocked = [any(w in bad for w in ws) for ws in named]
    choices = [[(len(d) + n, d, n) for d in ds if d in known for n in known[d]] for ds in parents]
    for c in choices:
        c.sort(key=lambda x: (-x[0], -len(x[1])))
    probes: dict[str, int] = {}
    tried = [[probes.setdefault(f"{d}{path[:n]}", len(probes)) for _, d, n in choices[number[h]] if n <= len(path)] for h, path in zip(hosts, paths, strict=True)]
    found = array.find([f"{RULE}{p}".encode() for p in probes]).tolist()
    strings, rules, verdicts = list(probes), [], []
    for h, tries in zip(hosts, tried, strict=True):
        hit = next((t for t in tries if found[t] >= 0), None)
        rules.append(None if hit is None else strings[hit])
        verdicts.append(VERDICTS[array.verdict[found[hit]]] if hit is not None else BLOCK if blocked[number[h]] else DEFAULT)
    return rules, verdicts


def shipped(spark: SparkSession, array: DigestArray) -> str:
    """Write the file to the shared folder and have every executor fetch it; its name there."""
    name = f"digests-{uuid.uuid4().hex}"
    path, fs = _folder(spark, f"{scratch_dir(spark)}/{name}")
    out = fs.create(path)
    for piece in array.pieces():
        for i in range(0, len(piece), 1 << 22):
            out.write(bytearray(piece[i : i + (1 << 22)]))
    out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host, in lower case, and path of a url; both empty without "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def filter_urls(rows: DataFrame, rules: DataFrame, words: Iterable[str] = WORDS, url: str = "url", most: int = MOST_ENTRIES, bits: int = 64) -> DataFrame:
    """rows with host, path, rule and verdict, in place of columns of those names.

    rules: verdict, host, path, as `entries` takes them. A rule fits its host and all subdomains where the path begins with
    its own; the longest rule decides, and rule is its host and path. Without a rule, a host name with one of `words` is
    blocked and any other allowed. A null url or one without "://" has an empty host and path, and is allowed.
    Up to `most` entries the list is one file, mapped by every worker; a longer list is joined by key and string.
    """
    spark, wanted = rows.sparkSession, ("host", "path", "rule", "verdict")
    host, path = parts_of(F.col(url))
    rows = rows.drop("rule", "verdict").withColumns({"host": host, "path": path})
    listed = entries(rules, words)
    if listed.count() > most:
        return _joined(rows, listed)
    name = shipped(spark, DigestArray.made(listed.toArrow(), bits))

    def run(batches):
        array = DigestArray.mapped(SparkFiles.get(name))
        for batch in batches:
            rules, verdicts = judged(array, batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.record_batch([*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in wanted[:2])
    return rows.mapInArrow(lean(run), ", ".join(filter(None, [kinds, "host string, path string, rule string, verdict string"])))


def _joined(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """The same by joins, for lists beyond a file: distinct hosts meet the list, and distinct probes."""
    listed = listed.withColumn("key", F.xxhash64("entry"))

    def met(probes: DataFrame, *columns: str) -> DataFrame:  # probe strings, distinct
        p = probes.withColumn("key", F.xxhash64("probe"))
        return p.join(listed, (p["key"] == listed["key"]) & (p["probe"] == listed["entry"])).select("probe", *columns)

    hosts = rows.select("host").distinct()
    labels = F.split("host", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    domains = hosts.select("host", F.explode(above).alias("domain"))
    known = met(domains.select(F.concat(F.lit(HOST), "domain").alias("probe")).distinct(), "lengths").withColumn("domain", F.substring("probe", 2, 1 << 30))
    choices = domains.join(known, "domain").select("host", "domain", F.explode("lengths").alias("n"))
    words = hosts.select("host", F.explode(F.split("host", "[.-]")).alias("word"))
    bad = met(words.select(F.concat(F.lit(WORD), "word").alias("probe")).distinct(), "verdict").select(F.substring("probe", 2, 1 << 30).alias("word"))
    blocked = words.join(bad, "word").select("host").distinct().withColumn("bad", F.lit(True))
    urls = rows.select("host", "path").distinct()  # a hot host's choices meet each of its paths once
    tries = urls.join(choices, "host").where(F.col("n") <= F.length("path")).select("host", "path", "domain", F.concat("domain", F.expr("substring(path, 1, n)")).alias("rule"))
    hits = met(tries.select(F.concat(F.lit(RULE), "rule").alias("probe")).distinct(), "verdict").select(F.substring("probe", 2, 1 << 30).alias("rule"), F.col("verdict").alias("v"))
    best = tries.join(hits, "rule").groupBy("host", "path").agg(F.max_by(F.struct("rule", "v"), F.struct(F.length("rule"), F.length("domain"))).alias("best"))
    out = rows.join(best, ["host", "path"], "left").join(blocked, "host", "left")
    by_rule = F.when(F.col("best.v") == 1, BLOCK).when(F.col("best.v") == 0, ALLOW)
    verdict = F.coalesce(by_rule, F.when(F.col("bad"), BLOCK), F.lit(DEFAULT))
    return out.select(*(c for c in rows.columns if c not in ("host", "path")), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame([*RULES], "verdict string, host string, path string")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")
