"""Variant files as DataFrames: schema from the header, wide and tidy layouts, and text output.

Only the header is read on the driver, through Hadoop's file systems. Records are lines of spark.read.text, or for block-compressed
files of the splitting source in `blocks`, so that both split over tasks, and fields are Column expressions over a line:
columns that a query does not use are never parsed.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions import annotation
from lociframe.sources import blocks

# Number of reserved tags in the VCF specification.
INFO_NUMBER = {"AA": "1", "AC": "A", "AD": "R", "ADF": "R", "ADR": "R", "AF": "A", "AN": "1", "BQ": "1", "CIGAR": "A", "DB": "0", "DP": "1", "END": "1", "H2": "0", "H3": "0", "MQ": "1", "MQ0": "1", "NS": "1", "SB": "4", "SOMATIC": "0", "VALIDATED": "0", "1000G": "0"}
FORMAT_NUMBER = {"AD": "R", "ADF": "R", "ADR": "R", "DP": "1", "EC": "A", "FT": "1", "GL": "G", "GP": "G", "GQ": "1", "GT": "1", "HQ": "2", "MQ": "1", "PL": "G", "PP": "G", "PQ": "1", "PS": "1"}
TYPES = {"Integer": "int", "Float": "float", "Flag": "boolean", "String": "string", "Character": "string"}
META = re.compile(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)')


@dataclass
class Tag:
    name: str
    number: str
    type: str
    description: str = ""

    @property
    def is_list(self) -> bool:
        return self.number not in ("0", "1")

    @property
    def ddl(self) -> str:
        t = TYPES.get(self.type, "string")
        return f"array<{t}>" if self.is_list else t


@dataclass
class Header:
    info: dict[str, Tag] = field(default_factory=dict)
    format: dict[str, Tag] = field(default_factory=dict)
    contigs: dict[str, int | None] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)
    lines: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def parse_header(lines: list[str]) -> Header:
    """Definitions of a header. A reserved tag with a wrong Number is corrected with a warning; Number=. is left alone. Samples
    without any FORMAT get a GT of type String."""
    h = Header(lines=[x for x in lines if x.startswith("##")])
    for line in lines:
        m = re.match(r"##(INFO|FORMAT|contig)=<(.*)>\s*$", line)
        if m:
            own = {k: v.strip('"') for k, v in META.findall(m[2])}
            if m[1] == "contig":
                h.contigs[own["ID"]] = int(own["length"]) if own.get("length", "").isdigit() else None
                continue
            known = INFO_NUMBER if m[1] == "INFO" else FORMAT_NUMBER
            number = own.get("Number", ".")
            right = known.get(own["ID"])
            if right and number not in (right, "."):
                h.warnings.append(f"{m[1]}/{own['ID']}: Number={number} corrected to {right}")
                number = right
            (h.info if m[1] == "INFO" else h.format)[own["ID"]] = Tag(own["ID"], number, own.get("Type", "String"), own.get("Description", ""))
        elif line.startswith("#CHROM"):
            h.samples = line.rstrip("\n").split("\t")[9:]
    if h.samples and not h.format:
        h.format["GT"] = Tag("GT", "1", "String")
    return h


def read_header(spark: SparkSession, path: str) -> Header:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    stream = fs.open(p)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    lines = []
    try:
        while (line := reader.readLine()) is not None and line.startswith("#"):
            lines.append(line)
    finally:
        reader.close()
    return parse_header(lines)


def _value(text: Column, tag: Tag, keep_missing: bool) -> Column:
    t = TYPES.get(tag.type, "string")
    known = F.nullif(text, F.lit("."))
    if not tag.is_list:
        return known.try_cast(t)
    items = F.transform(F.split(known, ","), lambda x: F.nullif(x, F.lit(".")).try_cast(t))
    return items if keep_missing else F.filter(items, lambda x: x.isNotNull())


def info_value(info: Column, name: str) -> Column:
    """Text of the first NAME=... of an INFO field; null without one. A tag may come twice in a record."""
    return F.nullif(F.regexp_extract(info, f"(?:^|;){re.escape(name)}=([^;]*)", 1), F.lit(""))


def has_flag(info: Column, name: str) -> Column:
    return F.coalesce(info.rlike(f"(?:^|;){re.escape(name)}(?:[;=]|$)"), F.lit(False))


def record_lines(spark: SparkSession, path: str | list[str], region: str | None = None, split: int = blocks.SPLIT) -> DataFrame:
    """Records as `value`. Compressed files are read in parts of `split` bytes where workers can open them, with the region
    pushed into the source; others by Spark's text reader, which takes a compressed file in one task."""
    paths = [path] if isinstance(path, str) else path
    if all(p.endswith((".gz", ".bgz", ".bgzf")) and blocks.readable(p) and not re.search(r"[*?{\[]", p) for p in paths):
        blocks.register(spark)
        own = spark.read.format("variant_lines").option("paths", json.dumps(paths)).option("columns", "CHROM,POS,LAST,value").option("splitbytes", str(split)).load()
        if region:
            chrom, begin, end = region_bounds(region)
            own = own.where(F.col("CHROM") == chrom)
            own = own if begin is None else own.where((F.col("LAST") >= begin) & (F.col("POS") <= end))
        return own.select("value")
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))


def region_bounds(region: str) -> tuple[str, int | None, int | None]:
    """Contig, and first and last position, of chrom, chrom:position or chrom:begin-end."""
    chrom, _, span = region.partition(":")
    begin, _, end = span.replace(",", "").partition("-")
    return (chrom, int(begin), int(end or begin)) if span else (chrom, None, None)


def read_vcf(spark: SparkSession, path: str | list[str], layout: str = "wide", region: str | None = None, samples: list[str] | None = None, columns: list[str] | None = None, keep_missing: bool = False, vep: str | None = None, vep_fields: list[str] | None = None, include_info: bool = True, include_format: bool = True, split: int = blocks.SPLIT) -> DataFrame:
    """CHROM, POS, ID, REF, ALT, QUAL, FILTER, INFO_*, and FORMAT_<field>_<sample> (wide), SAMPLE_ID, FORMAT_<field> (tidy), or
    samples, an array of structs of sample_id and the fields (nested: the layout of expressions, formats and families).

    include_info and include_format leave out the INFO and the sample columns. Several paths are read as one table, with the header of the first. vep="all" or "first" adds VEP_<field> for the fields of
    a CSQ, BCSQ or ANN tag, or those in vep_fields: arrays over transcripts, or the first transcript's values.

    "." is null for ID, QUAL and tags, an empty list for ALT and FILTER; an absent flag is false. Missing elements of lists
    drop unless keep_missing. region is chrom or chrom:begin-end, 1-based and closed, and keeps records whose REF overlaps it;
    an unknown region gives no rows. A block-compressed file is read in parts of `split` bytes. samples reorders and limits samples; columns selects by name.
    """
    h = read_header(spark, path if isinstance(path, str) else path[0])
    cols = F.split(F.col("value"), "\t")
    f = record_lines(spark, path, region, split)
    get = lambda i: F.try_element_at(cols, F.lit(i + 1))
    core = {
        "CHROM": get(0), "POS": get(1).try_cast("long"), "ID": F.nullif(get(2), F.lit(".")), "REF": get(3),
        "ALT": F.filter(F.split(get(4), ","), lambda x: x != "."), "QUAL": F.nullif(get(5), F.lit(".")).try_cast("double"), "FILTER": F.filter(F.split(get(6), ";"), lambda x: x != "."),
    }
    info = get(7)
    for tag in h.info.values() if include_info else ():
        core[f"INFO_{tag.name}"] = has_flag(info, tag.name) if tag.number == "0" or tag.type == "Flag" else _value(info_value(info, tag.name), tag, keep_missing)
    if vep and (name := annotation.detect({t: "" for t in h.info})):
        if vep not in ("all", "first"):
            raise ValueError(f"no such transcripts: {vep}")
        names = annotation.fields(h.info[name].description)
        keep = names if vep_fields is None else [n for n in names if n in vep_fields]
        trs = annotation.transcripts(info_value(info, name), names, keep)
        field = lambda n: F.transform(trs, lambda t: t[n]) if vep == "all" else F.try_element_at(trs, F.lit(1))[n]
        core |= {f"VEP_{n}": field(n) for n in keep}
    picked = [] if not include_format else [(h.samples.index(s), s) for s in (samples if samples is not None else h.samples)]
    keys = F.split(get(8), ":")
    one = lambda i, tag: _value(F.try_element_at(F.split(get(9 + i), ":"), F.nullif(F.array_position(keys, tag.name), F.lit(0)).cast("int")), tag, keep_missing)
    if layout == "wide":
        core |= {f"FORMAT_{t.name}_{s}": one(i, t) for i, s in picked for t in h.format.values()}
        out = f.select(*(c.alias(n) for n, c in core.items()))
    elif layout == "nested":
        calls = F.array(*(F.struct(F.lit(s).alias("sample_id"), *(one(i, t).alias(t.name) for t in h.format.values())) for i, s in picked)) if picked else F.array().cast("array<struct<sample_id:string>>")
        out = f.select(*(c.alias(n) for n, c in core.items()), calls.alias("samples"))
    elif layout != "tidy":
        raise ValueError(f"no such layout: {layout}")
    elif picked:
        rows = F.array(*(F.struct(F.lit(s).alias("SAMPLE_ID"), *(one(i, t).alias(f"FORMAT_{t.name}") for t in h.format.values())) for i, s in picked))
        out = f.select(*(c.alias(n) for n, c in core.items()), F.inline(rows))
    else:
        out = f.select(*(c.alias(n) for n, c in core.items()))
    if region:
        chrom, begin, end = region_bounds(region)
        out = out.where(F.col("CHROM") == chrom)
        if begin is not None:
            out = out.where((F.col("POS") + F.length("REF") - 1 >= begin) & (F.col("POS") <= end))
    return out.select(*columns) if columns else out


def write_parquet(df: DataFrame, path: str, header: Header | None = None, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet with zstd; the header travels as metadata of the first column, which survives writing and reading."""
    if header:
        first = df.columns[0]
        df = df.withMetadata(first, {"vcf_header": "\n".join(header.lines)})
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def stored_header(df: DataFrame) -> str | None:
    return next((f.metadata["vcf_header"] for f in df.schema.fields if "vcf_header" in f.metadata), None)


def head(spark: SparkSession, path: str, records: int = 0) -> list[str]:
    """The header's lines and the first records."""
    lines = read_header(spark, path)
    top = [*lines.lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *lines.samples] if lines.samples else [])])]
    return top + [r[0] for r in spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).limit(records).collect()]


def variant_table(spark: SparkSession, name: str, paths: str | list[str], layout: str = "tidy", mode: str = "errorifexists", **options) -> DataFrame:
    """Files loaded into a catalog table of Parquet, which carries the first one's header; options as for read_vcf."""
    df = read_vcf(spark, paths, layout, **options)
    header = read_header(spark, paths if isinstance(paths, str) else paths[0])
    df.withMetadata(df.columns[0], {"vcf_header": "\n".join(header.lines)}).write.mode(mode).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def lazy_view(spark: SparkSession, name: str, path: str | list[str], **options) -> None:
    """A view of files for SQL: each query parses the columns that it reads."""
    read_vcf(spark, path, **options).createOrReplaceTempView(name)


def split_by_sample(tidy: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder of Parquet per sample."""
    write_parquet(tidy, path, partition_by=["SAMPLE_ID"], mode=mode)


def write_vcf(tidy: DataFrame, path: str, header: Header, samples: list[str], compression: str = "none") -> None:
    """A folder with the header and the records as text, in parts that follow one another by name. compression: a codec of
    Spark's text sink, or "blocks" for block-compressed parts, which together are one such file."""
    fixed = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]
    lines = [(i, x) for i, x in enumerate([*header.lines, "\t".join(fixed)])]
    top = tidy.sparkSession.createDataFrame(lines, "i int, value string").coalesce(1).sortWithinPartitions("i").select("value")
    if compression == "blocks":
        blocks.register(tidy.sparkSession)
        writer = as_records(tidy, header, samples).write.format("variant_lines").mode("append")
        writer.option("path", path).option("header", "\n".join([*header.lines, "\t".join(fixed)])).save()
        return
    top.unionByName(as_records(tidy, header, samples)).write.option("compression", compression).text(path)


def as_records(tidy: DataFrame, header: Header, samples: list[str]) -> DataFrame:
    """Text records (value), sorted by contig in header order and POS, of tidy rows as read_vcf gives them."""
    fmt = list(header.format.values())
    site = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", *(f"INFO_{t.name}" for t in header.info.values())]
    rows = tidy.withColumn("_call", _call(fmt, lambda t: F.col(f"FORMAT_{t.name}"))).groupBy(*site).pivot("SAMPLE_ID", samples).agg(F.first("_call"))
    return _sorted_lines(rows, header, [F.coalesce(F.col(f"`{s}`"), F.lit(".")) for s in samples])


def wide_records(wide: DataFrame, header: Header, samples: list[str]) -> DataFrame:
    """The same of wide rows, with a column FORMAT_<field>_<sample> for each; no row is shuffled but for the sort."""
    fmt = list(header.format.values())
    return _sorted_lines(wide, header, [_call(fmt, lambda t: F.col(f"`FORMAT_{t.name}_{s}`")) for s in samples])  # noqa: B023  used at once


def nested_records(nested: DataFrame, header: Header) -> DataFrame:
    """The same of nested rows: the samples' columns in the order of their arrays."""
    fmt = list(header.format.values())
    calls = F.array_join(F.transform("samples", lambda s: _call(fmt, lambda t: s[t.name])), "\t")
    return _sorted_lines(nested, header, [calls])


def _tag_text(c: Column, t: Tag) -> Column:
    return F.coalesce(F.array_join(c.cast("array<string>"), ",", ".") if t.is_list else c.cast("string"), F.lit("."))


def _call(fmt: list[Tag], column) -> Column:
    """A sample's values, colons between."""
    return F.concat_ws(":", *(F.when(_tag_text(column(t), t) == "", ".").otherwise(_tag_text(column(t), t)) for t in fmt))


def _sorted_lines(rows: DataFrame, header: Header, calls: list[Column]) -> DataFrame:
    def tag(t: Tag) -> Column:
        c = f"INFO_{t.name}"
        if t.number == "0":
            return F.when(F.col(c), F.lit(t.name))
        present = F.col(c).isNotNull() & ((F.size(c) > 0) if t.is_list else F.lit(True))
        return F.when(present, F.concat(F.lit(t.name + "="), _tag_text(F.col(c), t)))

    or_dot = lambda c: F.when(c == "", ".").otherwise(F.coalesce(c, F.lit(".")))
    line = F.concat_ws(
        "\t", "CHROM", F.col("POS").cast("string"), F.coalesce("ID", F.lit(".")), "REF", or_dot(F.array_join("ALT", ",")), F.coalesce(F.regexp_replace(F.col("QUAL").cast("string"), r"\.0$", ""), F.lit(".")), or_dot(F.array_join("FILTER", ";")),
        or_dot(F.concat_ws(";", *map(tag, header.info.values()))), *([F.lit(":".join(t.name for t in header.format.values())), *calls] if calls else []),
    )
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, header.contigs)), F.col("CHROM")), F.lit(0)) if header.contigs else F.lit(0)
    return rows.select(rank.alias("_rank"), "CHROM", "POS", line.alias("value")).orderBy("_rank", "CHROM", "POS").select("value")


# --- headers


def reheadered(header: Header, samples: list[str] | dict[str, str] | None = None, contigs: dict[str, int | None] | None = None) -> Header:
    """The header with other sample names (all in order, or new by old), or with the contigs given, in place of its own."""
    names, lines = list(header.samples), list(header.lines)
    if samples is not None:
        names = [samples.get(n, n) for n in names] if isinstance(samples, dict) else list(samples)
        if len(names) != len(header.samples) or len(set(names)) < len(names):
            raise ValueError("as many sample names as before, all different")
    own = dict(header.contigs)
    if contigs is not None:
        own = dict(contigs)
        lines = [x for x in lines if not x.startswith("##contig=")] + [f"##contig=<ID={c}" + (f",length={n}>" if n is not None else ">") for c, n in own.items()]
    return Header(dict(header.info), dict(header.format), own, names, lines, list(header.warnings))


def with_samples(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    """Rows of any layout with samples renamed."""
    pairs = dict(zip(old, new, strict=True))
    table = F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
    if "samples" in df.columns:
        return df.withColumn("samples", F.transform("samples", lambda s: s.withField("sample_id", F.coalesce(F.try_element_at(table, s["sample_id"]), s["sample_id"]))))
    if "SAMPLE_ID" in df.columns:
        return df.withColumn("SAMPLE_ID", F.coalesce(F.try_element_at(table, F.col("SAMPLE_ID")), "SAMPLE_ID"))
    names = {c: c for c in df.columns}
    for c in df.columns:
        hit = next((s for s in sorted(pairs, key=len, reverse=True) if c.startswith("FORMAT_") and c.endswith(f"_{s}")), None)
        names[c] = c[: -len(hit)] + pairs[hit] if hit else c
    return df.toDF(*names.values())


def with_annotations(df: DataFrame, header: Header, names: dict[str, str]) -> tuple[DataFrame, Header]:
    """INFO/x, FORMAT/x and FILTER/x renamed, in rows of any layout and in the header."""
    out, info, fmt, lines = df, dict(header.info), dict(header.format), list(header.lines)
    for old, new in names.items():
        kind, _, tag = old.partition("/")
        new = new.rpartition("/")[2]
        if kind == "INFO":
            out = out.withColumnRenamed(f"INFO_{tag}", f"INFO_{new}")
            info = {new if k == tag else k: Tag(new, t.number, t.type, t.description) if k == tag else t for k, t in info.items()}
        elif kind == "FORMAT":
            if "samples" in out.columns:
                fields = out.schema["samples"].dataType.elementType.names
                out = out.withColumn("samples", F.transform("samples", lambda s: F.struct(*(s[f].alias(new if f == tag else f) for f in fields))))  # noqa: B023  used at once
            else:
                out = out.toDF(*(c.replace(f"FORMAT_{tag}", f"FORMAT_{new}", 1) if c == f"FORMAT_{tag}" or c.startswith(f"FORMAT_{tag}_") else c for c in out.columns))
            fmt = {new if k == tag else k: Tag(new, t.number, t.type, t.description) if k == tag else t for k, t in fmt.items()}
        elif kind == "FILTER":
            out = out.withColumn("FILTER", F.transform("FILTER", lambda x: F.when(x == tag, new).otherwise(x)))  # noqa: B023  used at once
        else:
            raise ValueError(f"no such field: {old}")
        lines = [x.replace(f"##{kind}=<ID={tag},", f"##{kind}=<ID={new},", 1) if x.startswith(f"##{kind}=<ID={tag},") else x for x in lines]
    return out, Header(info, fmt, dict(header.contigs), list(header.samples), lines, list(header.warnings))


def parquet_info(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Name, type and whether null is allowed for each column of a Parquet table, and its number of rows, from the footers."""
    df = spark.read.parquet(path)
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]
    return spark.createDataFrame(rows, "column string, type string, nullable boolean"), df.count()
