"""Splitting source and sink for block-compressed variant text, also from SQL: `USING variant_lines OPTIONS (path '...')`.

A block-compressed file is a row of gzip members of at most 64 KB, each with its own size in its header. A partition owns
the blocks that begin in its range of bytes, which it finds by the header's fixed bytes, and the lines that begin after the first
line end in them, up to the first line end at or after the next partition's first block. So every line is read once
whatever the split size. Plain text is split in the same way; a file that is gzip but not in blocks is one partition.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

SPLIT = 64 << 20  # bytes of a file per partition
BATCH = 4 << 20  # bytes of text per batch
MOST = 1 << 16  # bytes of a block, before and after compression
MAGIC = b"\x1f\x8b\x08\x04"
# Fixed value: the empty block that ends a block-compressed file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
COLUMNS = {"CHROM": pa.string(), "POS": pa.int64(), "LAST": pa.int64(), "ID": pa.string(), "REF": pa.string(), "ALT": pa.list_(pa.string()), "QUAL": pa.float64(), "FILTER": pa.list_(pa.string()), "INFO": pa.string(), "value": pa.string()}
DDL = {pa.string(): "string", pa.int64(): "long", pa.float64(): "double", pa.list_(pa.string()): "array<string>"}
SCHEMES = ("file", "s3", "gs", "gcs", "hdfs", "abfs", "abfss")


def readable(path: str) -> bool:
    """Whether workers can open the path themselves."""
    scheme, sep, _ = path.partition("://")
    return path.startswith("/") or scheme.startswith("file:") or bool(sep) and scheme in SCHEMES


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:"))


def block_size(data: bytes, at: int = 0) -> int | None:
    """Bytes of the block that begins at data[at]; None if there is no block header, 0 if the header isn't all there."""
    if len(data) < at + 12:
        return 0 if MAGIC.startswith(data[at : at + 4]) else None
    if data[at : at + 4] != MAGIC:
        return None
    extra = struct.unpack_from("<H", data, at + 10)[0]
    i, end = at + 12, at + 12 + extra
    if len(data) < end:
        return 0
    while i + 4 <= end:
        kind, n = data[i : i + 2], struct.unpack_from("<H", data, i + 2)[0]
        if kind == b"BC" and n == 2:
            return struct.unpack_from("<H", data, i + 4)[0] + 1
        i += 4 + n
    return None


def first_block(file, begin: int, size: int) -> int:
    """Where the first block at or after `begin` begins: a header whose size leads to another header, and so on for longer
    than a block can be, or to the end. Bytes within a block that look like blocks lead out of them sooner."""

    def chained(data: bytes, i: int, ends: bool) -> bool:
        at = i
        while at - i <= MOST and not (ends and at >= len(data)):  # a last block that is cut short is found, to be an error
            n = block_size(data, at)
            if not n:
                return False
            at += n
        return True

    at = begin
    while at < size:
        file.seek(at)
        data = file.read(4 * MOST)
        i = data.find(MAGIC)
        while 0 <= i < 2 * MOST:
            if chained(data, i, at + len(data) >= size):
                return at + i
            i = data.find(MAGIC, i + 1)
        at += 2 * MOST
    return size


def compressed_pieces(file, begin: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Every block from the first at or after begin: where it begins, and its text."""
    at, data, base = first_block(file, begin, size), b"", 0
    base = at
    file.seek(at)
    while True:
        n = block_size(data, at - base)
        while not n or len(data) < at - base + n:
            more = file.read(16 * MOST)
            if not more:
                if at < size:
                    raise ValueError(f"the block at byte {at} is damaged or cut short")
                return
            data, base = data[at - base :] + more, at
            n = block_size(data)
            if n is None:
                raise ValueError(f"no block begins at byte {at}")
        header = 12 + struct.unpack_from("<H", data, at - base + 10)[0]
        text = zlib.decompress(data[at - base + header : at - base + n - 8], -15)
        if zlib.crc32(text) != struct.unpack_from("<I", data, at - base + n - 8)[0]:
            raise ValueError(f"the block at byte {at} has another checksum")
        yield at, text
        at += n


def plain_pieces(file, begin: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    at = begin
    file.seek(at)
    while at < size:
        text = file.read(min(BATCH, end - at) if at < end else MOST)
        yield at, text
        at += len(text)


def owned(pieces: Iterator[tuple[int, bytes]], begin: int, end: int) -> Iterator[bytes]:
    """The text of the lines that are the range's own."""
    started = begin == 0
    for at, text in pieces:
        if at >= end:
            cut = text.find(b"\n") + 1
            if not started:
                return
            yield text[:cut] if cut else text
            if cut:
                return
            continue
        if not started:
            cut = text.find(b"\n") + 1
            if not cut:
                continue
            text, started = text[cut:], True
        yield text


def gathered(texts: Iterator[bytes]) -> Iterator[list[str]]:
    """Record lines, some BATCH bytes of them at once."""
    held, n = [], 0
    for text in texts:
        held.append(text)
        n += len(text)
        if n >= BATCH and b"\n" in text:
            whole, _, rest = b"".join(held).rpartition(b"\n")
            yield _records(whole)
            held, n = [rest], len(rest)
    yield _records(b"".join(held))


def _records(text: bytes) -> list[str]:
    return [x for x in text.decode("utf-8", "replace").replace("\r\n", "\n").split("\n") if x and x[0] != "#"]


@dataclass
class Piece(InputPartition):
    path: str
    begin: int
    end: int
    size: int
    kind: str  # blocks, plain or gzip

    def __post_init__(self):
        self.value = self.path


@dataclass
class Bounds:
    """What pushed filters leave: contigs (None: all) and closed ranges."""

    contigs: set[str] | None = None
    low: dict[str, int] = field(default_factory=dict)
    high: dict[str, int] = field(default_factory=dict)

    def take(self, f: Filter) -> bool:
        """Whether the filter is now part of the bounds, exactly."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name == "CHROM" and isinstance(f, EqualTo | In):
            own = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.contigs = own if self.contigs is None else self.contigs & own
            return True
        if name not in ("POS", "LAST") or not isinstance(getattr(f, "value", None), int):
            return False
        least = {EqualTo: 0, GreaterThanOrEqual: 0, GreaterThan: 1}.get(type(f))
        most = {EqualTo: 0, LessThanOrEqual: 0, LessThan: -1}.get(type(f))
        if least is not None:
            self.low[name] = max(self.low.get(name, f.value + least), f.value + least)
        if most is not None:
            self.high[name] = min(self.high.get(name, f.value + most), f.value + most)
        return least is not None or most is not None

    def ok(self, chrom: str, pos: int | None, last: int | None) -> bool:
        if self.contigs is not None and chrom not in self.contigs:
            return False
        at = {"POS": pos, "LAST": last}
        return all(at[c] is not None and at[c] >= x for c, x in self.low.items()) and all(at[c] is not None and at[c] <= x for c, x in self.high.items())


def record(line: str) -> tuple:
    """CHROM, POS, LAST (of the REF allele), ID, REF, ALT, QUAL, FILTER, INFO, value; missing fields are null."""
    x = line.split("\t", 8)
    x += [None] * (8 - len(x))
    known = lambda v: None if v == "." else v
    items = lambda v, sep: None if v is None else [i for i in v.split(sep) if i != "."]
    try:
        pos = int(x[1])
    except (TypeError, ValueError):
        pos = None
    try:
        qual = float(known(x[5]))
    except (TypeError, ValueError):
        qual = None
    last = None if pos is None or x[3] is None else pos + len(x[3]) - 1
    return x[0], pos, last, known(x[2]), x[3], items(x[4], ","), qual, items(x[6], ";"), known(x[7]), line


class VariantLines(DataSource):
    """Records of variant files, each in its core columns and whole as `value`. Options: path, or paths as JSON (files or
    folders); columns (names with commas between; all); splitbytes."""

    @classmethod
    def name(cls) -> str:
        return "variant_lines"

    def columns(self) -> list[str]:
        names = [c.strip() for c in self.options.get("columns", ",".join(COLUMNS)).split(",")]
        if unknown := [c for c in names if c not in COLUMNS]:
            raise ValueError(f"no such columns: {unknown}")
        return names

    def schema(self) -> str:
        return ", ".join(f"{c} {DDL[COLUMNS[c]]}" for c in self.columns())

    def reader(self, schema: StructType) -> DataSourceReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return LineReader(paths, self.columns(), int(self.options.get("splitbytes", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BlockWriter(self.options["path"], self.options.get("header", ""), overwrite)


class LineReader(DataSourceReader):
    def __init__(self, paths: list[str], columns: list[str], split: int):
        self.paths, self.columns, self.split, self.bounds = paths, columns, max(1, split), Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if not self.bounds.take(f):
                yield f

    def partitions(self) -> list[Piece]:
        out = []
        for path in self.paths:
            system, inner = opened(path)
            found = system.get_file_info(inner)
            if found.type == pafs.FileType.NotFound:
                raise FileNotFoundError(path)
            files = [found] if found.type == pafs.FileType.File else sorted(system.get_file_info(pafs.FileSelector(inner)), key=lambda x: x.path)
            for f in files:
                if f.type != pafs.FileType.File or f.base_name.startswith(("_", ".")) or not f.size:
                    continue
                with system.open_input_file(f.path) as file:
                    head = file.read(MOST)
                kind = "blocks" if block_size(head) else "gzip" if head.startswith(b"\x1f\x8b") else "plain"
                step = f.size if kind == "gzip" else self.split
                whole = path if found.type == pafs.FileType.File else f"{path.rstrip('/')}/{f.base_name}"
                out += [Piece(whole, at, min(at + step, f.size), f.size, kind) for at in range(0, f.size, step)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        p, (system, inner) = partition, opened(partition.path)
        with system.open_input_file(inner) as file:
            if p.kind == "gzip":
                with pa.CompressedInputStream(file, "gzip") as text:
                    lines = gathered(iter(lambda: text.read(BATCH), b""))
                    yield from self._batches(lines)
            else:
                pieces = compressed_pieces(file, p.begin, p.size) if p.kind == "blocks" else plain_pieces(file, p.begin, p.end, p.size)
                yield from self._batches(gathered(owned(pieces, p.begin, p.end)))

    def _batches(self, lines: Iterator[list[str]]) -> Iterator[pa.RecordBatch]:
        names = [*COLUMNS]
        places, schema = [names.index(c) for c in self.columns], pa.schema([(c, COLUMNS[c]) for c in self.columns])
        for some in lines:
            rows = [r for r in map(record, some) if self.bounds.ok(*r[:3])]
            if rows:
                yield pa.record_batch([pa.array([r[i] for r in rows], schema.field(c).type) for c, i in zip(self.columns, places, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    path: str


class BlockWriter(DataSourceWriter):
    """Rows of one text column as block-compressed parts, which follow one another by name; the header leads the first."""

    def __init__(self, path: str, header: str, overwrite: bool):
        self.path, self.header = path, header
        system, inner = opened(path)
        found = system.get_file_info(inner)
        if found.type != pafs.FileType.NotFound and not overwrite:
            if found.type == pafs.FileType.File or system.get_file_info(pafs.FileSelector(inner)):
                raise FileExistsError(path)
        self.old = [f.path for f in system.get_file_info(pafs.FileSelector(inner))] if found.type == pafs.FileType.Directory else []
        system.create_dir(inner, recursive=True)

    def write(self, iterator) -> Written:
        system, inner = opened(self.path)
        part = TaskContext.get().partitionId()
        name = f"{inner}/part-{part:05d}-{uuid.uuid4().hex}.vcf.gz"
        with system.open_output_stream(name, compression=None) as out:
            held = bytearray((self.header.rstrip("\n") + "\n").encode() if self.header and part == 0 else b"")
            for row in iterator:
                held += (row[0] or "").encode() + b"\n"
                while len(held) >= MOST - 256:
                    out.write(block(bytes(held[: MOST - 256])))
                    del held[: MOST - 256]
            if held:
                out.write(block(bytes(held)))
            out.write(END)
        return Written(name)

    def commit(self, messages) -> None:
        """Only what committed tasks wrote stays."""
        system, inner = opened(self.path)
        good = {m.path for m in messages if m}
        for f in system.get_file_info(pafs.FileSelector(inner)):
            if f.path not in good and (f.path in self.old or f.base_name.startswith("part-")):
                system.delete_file(f.path)
        with system.open_output_stream(f"{inner}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        system, _ = opened(self.path)
        for m in messages:
            if m:
                system.delete_file(m.path)


def block(text: bytes) -> bytes:
    """One block of at most MOST - 256 bytes of text."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(text) + packer.flush()
    if len(body) + 26 > MOST:  # text that cannot be compressed is stored
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packer.compress(text) + packer.flush()
    return MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text))


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VariantLines)
