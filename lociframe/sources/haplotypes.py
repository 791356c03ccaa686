"""Files of genotype probabilities and haplotypes: GEN and SAMPLE, HAP and SAMPLE, HAP, LEGEND and SAMPLE, and tables of one person's genotypes.

Files that go together go together by line number, which lines get by their split's place in the file and a count within it, so
that no task reads a whole file. Only sample files, as long as the cohort, are read on the driver. Sites are in the nested layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.functions import variants as V
from lociframe.operators.sequence import WIDTH, fetched, settled

NAME = r"^([^:]+):(\d+)_([^_]+)_([^_]+)"  # CHROM:POS_REF_ALT


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """n (from 0) and value of a text file's lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"))
    lines = settled(lines)
    counts = lines.groupBy("start").agg(F.count("*").alias("m"), F.min("i").alias("first"))  # a row for each split
    before = F.coalesce(F.sum("m").over(Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a split's lines follow one another in one task, so their numbers there do too
    return lines.join(counts.select("start", "first", before.alias("before")), "start").select((F.col("before") + F.col("i") - F.col("first")).alias("n"), "value")


def read_samples(spark: SparkSession, path: str) -> list[str]:
    """Names of a sample file: its first column, after a line of column names and, where there is one, the line of types (0 0 0)."""
    rows = [r.value.split() for r in numbered_lines(spark, path).orderBy("n").collect() if r.value.strip()]
    return [r[0] for r in rows[2 if len(rows) > 1 and set(rows[1]) <= {"0", "D", "C", "P", "B"} else 1 :]]


def _site(name: Column) -> list[Column]:
    get = lambda i: F.nullif(F.regexp_extract(name, NAME, i), F.lit(""))
    return [get(1).alias("CHROM"), get(2).cast("long").alias("POS"), get(3).alias("REF"), F.array(get(4)).alias("ALT")]


def _haplotypes(x: Column, names: list[str]) -> Column:
    """samples with GT of two columns each: 0, 1 or ? (missing), with * if unphased, - for the second of a haploid one."""
    ids = F.array(*map(F.lit, names))
    bare = lambda v: F.when(F.replace(v, F.lit("*"), F.lit("")) == "?", ".").otherwise(F.replace(v, F.lit("*"), F.lit("")))

    def one(i: Column) -> Column:
        a, b = F.get(x, 2 * i), F.get(x, 2 * i + 1)
        gt = F.when(b == "-", bare(a)).otherwise(F.concat(bare(a), F.when(a.contains("*") | b.contains("*") | (a == "?"), "/").otherwise("|"), bare(b)))
        return F.struct(F.get(ids, i).alias("sample_id"), gt.alias("GT"))

    return F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), one) if names else F.array().cast("array<struct<sample_id:string,GT:string>>")


def read_gen(spark: SparkSession, gen: str, sample: str) -> DataFrame:
    """CHROM, POS, ID, REF, ALT, samples (GT, GP): GT is the genotype of a probability above 1/2 at least, else missing."""
    names = read_samples(spark, sample)
    x = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(gen).where(F.trim("value") != "").select(x.alias("x"))
    ids = F.array(*map(F.lit, names))
    gp = lambda i: F.transform(F.slice("x", 6 + 3 * i, F.lit(3)), lambda v: v.cast("double"))
    call = lambda p: F.when(p[0] > 0.5, "0/0").when(p[1] > 0.5, "0/1").when(p[2] > 0.5, "1/1").otherwise("./.")
    one = lambda i: V.let(gp(i), lambda p: F.struct(F.get(ids, i).alias("sample_id"), call(p).alias("GT"), p.alias("GP")))
    rsid = F.when(F.col("x")[1].rlike(NAME), None).otherwise(F.col("x")[1])
    return lines.select(*_site(F.col("x")[0]), rsid.alias("ID"), F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), one).alias("samples")).select("CHROM", "POS", "ID", "REF", "ALT", "samples")


def read_haps(spark: SparkSession, haps: str, sample: str) -> DataFrame:
    """CHROM, POS, ID, REF, ALT, samples (GT) of a HAP file whose lines begin with five site columns."""
    names = read_samples(spark, sample)
    lines = spark.read.text(haps).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("x"))
    rsid = F.when(F.col("x")[1].rlike(NAME), None).otherwise(F.col("x")[1])
    return lines.select(*_site(F.col("x")[0]), rsid.alias("ID"), _haplotypes(F.slice("x", 6, 2 * len(names)), names).alias("samples")).select("CHROM", "POS", "ID", "REF", "ALT", "samples")


def read_hap_legend(spark: SparkSession, hap: str, legend: str, sample: str) -> DataFrame:
    """CHROM, POS, REF, ALT, samples (GT): line n of the HAP file is that of the legend's n-th site."""
    names = read_samples(spark, sample)
    sites = numbered_lines(spark, legend).where("n > 0").select((F.col("n") - 1).alias("n"), F.split(F.trim("value"), r"\s+")[0].alias("name"))
    rows = numbered_lines(spark, hap).select("n", F.split(F.trim("value"), r"\s+").alias("x"))
    return rows.join(sites, "n").select(*_site(F.col("name")), _haplotypes(F.col("x"), names).alias("samples"))


def read_personal(spark: SparkSession, path: str, name: str, reference: DataFrame, width: int = WIDTH) -> DataFrame:
    """CHROM, POS, ID, REF, ALT, samples (GT) of one person's table: id, contig, position and one or two bases, tabs between; # begins
    comments, and -- is missing. REF is the reference's base; lines with other than bases (insertions, deletions) and those where the
    reference has none are left out."""
    x = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(x[0].alias("ID"), x[1].alias("CHROM"), x[2].cast("long").alias("POS"), F.trim(x[3]).alias("g"))
    rows = fetched(rows.where(F.col("g").rlike("^[ACGT-]{1,2}$")), reference, F.col("POS"), F.col("POS"), "REF", width).where("REF is not null").withColumn("REF", F.upper("REF"))
    alleles = F.filter(F.split("g", ""), lambda a: a != "")
    rows = rows.withColumn("ALT", F.array_sort(F.array_distinct(F.filter(alleles, lambda a: ~a.isin("-") & (a != F.col("REF"))))))
    number = lambda a: F.when(a == "-", ".").otherwise(F.when(a == F.col("REF"), "0").otherwise(F.array_position(F.col("ALT"), a).cast("string")))
    gt = F.array_join(F.transform(alleles, number), "/")
    return rows.select("CHROM", "POS", "ID", "REF", "ALT", F.array(F.struct(F.lit(name).alias("sample_id"), gt.alias("GT"))).alias("samples"))


# --- conversion -------------------------------------------------------------------------------------------------------


def site_name() -> Column:
    return F.concat(F.col("CHROM"), F.lit(":"), F.col("POS").cast("string"), F.lit("_"), F.col("REF"), F.lit("_"), F.get("ALT", F.lit(0)))


def _lead(sites: DataFrame) -> Column:
    rsid = F.coalesce(F.col("ID"), site_name()) if "ID" in sites.columns else site_name()
    return F.concat_ws(" ", site_name(), rsid, F.col("POS").cast("string"), "REF", F.get("ALT", F.lit(0)))


def gen_lines(sites: DataFrame, source: str = "GT") -> DataFrame:
    """Lines (value) of a GEN file, sites of one ALT by contig and position: probabilities of GP, or from PL, or 1 for the genotype
    (a third each where it is missing)."""

    def probabilities(s: Column) -> Column:
        if source == "GP":
            return s["GP"]
        if source == "PL":
            raw = F.transform(s["PL"], lambda v: F.pow(F.lit(10.0), -v / 10.0))
            return V.let(raw, lambda r: F.transform(r, lambda v: v / (r[0] + r[1] + r[2])))
        d = F.when(~V.in_class(s["GT"], "mis"), F.when(F.size(V.alleles(s["GT"])) == 1, 2 * V.dosage(s["GT"])).otherwise(V.dosage(s["GT"])))
        return F.when(d.isNull(), F.array(*[F.lit(0.33)] * 3)).otherwise(F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: (d == k).cast("double")))

    text = lambda p: F.array_join(F.transform(p, lambda v: F.call_function("format_number", v.cast("double"), F.lit("0.######"))), " ")
    third = F.array(*[F.lit(0.33)] * 3)
    each = F.array_join(F.transform("samples", lambda s: text(F.coalesce(probabilities(s), third))), " ")
    return _ordered(sites, F.concat_ws(" ", _lead(sites), each))


def _pair(gt: Column) -> Column:
    """The two haplotype columns of a genotype."""
    a = F.split(gt, "[/|]")
    sign = lambda v: F.when(v == ".", "?").otherwise(v)
    star = F.when(gt.contains("/") & ~a[0].eqNullSafe(F.lit(".")) & ~F.get(a, F.lit(1)).eqNullSafe(F.lit(".")), "*").otherwise("")
    return F.when(gt.isNull() | (gt == "."), "? ?").when(F.size(a) == 1, F.concat(a[0], F.lit(" -"))).otherwise(F.concat(sign(a[0]), star, F.lit(" "), sign(F.get(a, F.lit(1))), star))


def haps_lines(sites: DataFrame) -> DataFrame:
    """Lines of a HAP file with five site columns: two alleles a sample, * after those of unphased genotypes, ? for missing ones."""
    return _ordered(sites, F.concat_ws(" ", _lead(sites), F.array_join(F.transform("samples", lambda s: _pair(s["GT"])), " ")))


def hap_legend_lines(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of a HAP file and of its legend, in one order."""
    legend = F.concat_ws(" ", site_name(), F.col("POS").cast("string"), "REF", F.get("ALT", F.lit(0)))
    return _ordered(sites, F.array_join(F.transform("samples", lambda s: _pair(s["GT"])), " ")), _ordered(sites, legend)


def _ordered(sites: DataFrame, line: Column) -> DataFrame:
    return sites.where(F.size("ALT") == 1).select("CHROM", "POS", "REF", "ALT", line.alias("value")).orderBy("CHROM", "POS", "REF", "ALT").select("value")


def write_lines(lines: DataFrame, path: str, first: str | None = None, compression: str = "none") -> None:
    """A folder of text whose parts follow one another by name, with a first line."""
    if first is not None:
        top = lines.sparkSession.createDataFrame([(first,)], "value string").coalesce(1)
        lines = top.unionByName(lines)
    lines.write.option("compression", compression).text(path)


def sample_lines(names: list[str], legend: bool = False) -> list[str]:
    """The lines of a sample file, as long as the cohort."""
    return ["sample population group sex", *(f"{n} {n} {n} 2" for n in names)] if legend else ["ID_1 ID_2 missing", "0 0 0", *(f"{n} {n} 0" for n in names)]
