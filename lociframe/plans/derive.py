"""Variant views over the star-schema tables, so that every operator runs on given data.

The SQL text of SITE runs in Spark and in DuckDB alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REF = "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END"
SITE = f"""SELECT event_id AS site_id, concat('chr', CAST(1 + event_id % 5 AS STRING)) AS CHROM, 1 + (event_id * 7919) % 50021 AS POS, {REF} AS REF,
 CASE WHEN event_id % 7 = 0 THEN concat({REF}, 'AT') WHEN event_id % 11 = 0 THEN concat({REF}, ',', 'GG')
 ELSE CASE CAST((event_id + 1 + (event_id % 3)) % 4 AS INT) WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END END AS ALT0,
 value AS QUAL, event_type FROM events"""
# A deletion every eleventh site: the bases are swapped so that REF is the longer allele.
SITE = f"""SELECT site_id, CHROM, POS, CASE WHEN ALT0 LIKE '%,%' THEN concat(REF, 'GG') ELSE REF END AS REF,
 CASE WHEN ALT0 LIKE '%,%' THEN REF ELSE ALT0 END AS ALT, QUAL, event_type FROM ({SITE}) s0"""
N_SAMPLES = 8
GT_FIELDS = """CASE WHEN h < 5 THEN '0/0' WHEN h < 8 THEN '0/1' WHEN h = 8 THEN '1/1' ELSE './.' END AS GT,
 CAST((site_id * 7 + sample_id * 13) % 60 AS INT) AS DP, CAST((site_id * 11 + sample_id * 29) % 99 AS INT) AS GQ,
 CAST((site_id * 7 + sample_id * 13) % 60 - ((site_id * 7 + sample_id * 13) % 60) * (CASE WHEN h < 5 THEN 0 WHEN h < 8 THEN 1 ELSE 2 END) // 2 AS INT) AS AD0"""
H = "(site_id * 31 + sample_id * 17 + (site_id % 13) * sample_id) % 10"
GT = f"""SELECT *, {GT_FIELDS} FROM (SELECT *, {H} AS h FROM (SELECT s.*, CAST(unnest(range({N_SAMPLES})) AS INT) AS sample_id FROM ({SITE}) s) g0) g1"""
INTERVALS = "SELECT p_partkey, concat('chr', CAST(1 + p_partkey % 5 AS STRING)) AS c, (p_partkey * 25) % 50021 AS b, (p_partkey * 25) % 50021 + p_size AS e FROM part"


# Sites with a second ALT every sixth, and genotypes of all kinds: phased, haploid, half-missing, of the second ALT.
RSITE = f"""SELECT site_id, CHROM, POS, REF, ALT AS ALT1, concat(ALT, 'TT') AS ALT2, CASE WHEN site_id % 6 = 0 THEN 2 ELSE 1 END AS n_alt, QUAL, event_type FROM ({SITE}) s"""
KINDS = ["0/0", "0/1", "1/1", "./.", "0|1", "1|0", "1|1", "./1", "0", "1", "0/2", "1/2", "2|2", ".", "0|0", "0/0"]
ONE_ALT = ["0/0", "0/1", "1/1", "./.", "0|1", "1|0", "1|1", "./1", "0", "1", "0/1", "1/1", "0|0", ".", "0|0", "0/0"]
RH = "(site_id * 31 + sample_id * 17 + (site_id % 13) * sample_id) % (CASE WHEN site_id % 5 = 0 THEN 16 WHEN site_id % 5 = 1 THEN 4 WHEN site_id % 5 = 2 THEN 7 ELSE 10 END) + (CASE WHEN site_id % 15 = 2 THEN 9 ELSE 0 END)"
RH = f"(CASE WHEN site_id % 29 = 7 THEN 3 + 10 * ((site_id + sample_id) % 2) WHEN site_id % 31 = 5 AND sample_id NOT IN (1, 4) THEN 14 WHEN site_id % 37 = 3 THEN 4 + (site_id + sample_id) % 3 ELSE {RH} END)"
PICK = "(CASE WHEN n_alt = 2 THEN [{}] ELSE [{}] END)[{} + 1]".format(", ".join(f"'{k}'" for k in KINDS), ", ".join(f"'{k}'" for k in ONE_ALT), "{}")
RGT = f"SELECT *, {PICK.format(RH)} AS GT FROM (SELECT r.*, CAST(unnest(range({N_SAMPLES})) AS INT) AS sample_id FROM ({RSITE}) r) g0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DEALT = 16  # tasks for each part of the files that a scan reads


def many(df: DataFrame) -> int:
    """Tasks for heavy work on df, a scan: all cores get some, and they get no longer as tables grow."""
    return max(df.sparkSession.sparkContext.defaultParallelism, DEALT * df.rdd.getNumPartitions())


def spread(df: DataFrame) -> DataFrame:
    """df dealt anew before work that is heavy per row: over all cores, and in tasks that get no longer as tables grow."""
    return df.repartition(many(df))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_id, CHROM, POS, REF, ALT, QUAL, event_type. site_id is unique; a place has several sites beyond 250,105 events, and equal alleles
    beyond 1,000,420, so that joins by place take site_id along where the SQL tells sites apart."""
    return spark.sql(SITE.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy layout: a row per site and sample with h, GT, DP, GQ, AD0 (reads of REF; DP - AD0 are of ALT)."""
    g = spread(sites(spark, sf_dir)).withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(N_SAMPLES - 1)))).withColumn("h", F.expr(H))
    return with_fields(g)


def with_fields(g: DataFrame) -> DataFrame:
    depth = (F.col("site_id") * 7 + F.col("sample_id") * 13) % 60
    alts = F.when(F.col("h") < 5, 0).when(F.col("h") < 8, 1).otherwise(2)
    return g.withColumns({
        "GT": F.when(F.col("h") < 5, "0/0").when(F.col("h") < 8, "0/1").when(F.col("h") == 8, "1/1").otherwise("./."),
        "DP": depth.cast("int"), "GQ": ((F.col("site_id") * 11 + F.col("sample_id") * 29) % 99).cast("int"),
        "AD0": (depth - F.floor(depth * alts / 2)).cast("int"),
    })


def nested(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ("GT", "DP", "GQ", "AD")) -> DataFrame:
    """Canonical layout: site columns with ALT as an array and samples, an array of structs of sample_id and fields in its order."""
    one = spread(sites(spark, sf_dir)).withColumn("s", F.sequence(F.lit(0), F.lit(N_SAMPLES - 1)))
    depth = lambda i: (F.col("site_id") * 7 + i * 13) % 60
    h = lambda i: (F.col("site_id") * 31 + i * 17 + (F.col("site_id") % 13) * i) % 10

    def make(i):
        alts = F.when(h(i) < 5, 0).when(h(i) < 8, 1).otherwise(2)
        ad0 = (depth(i) - F.floor(depth(i) * alts / 2)).cast("int")
        all_ = {
            "GT": F.when(h(i) < 5, "0/0").when(h(i) < 8, "0/1").when(h(i) == 8, "1/1").otherwise("./."),
            "DP": depth(i).cast("int"), "GQ": ((F.col("site_id") * 11 + i * 29) % 99).cast("int"), "AD": F.array(ad0, depth(i).cast("int") - ad0),
        }
        return F.struct(i.alias("sample_id"), *(all_[c].alias(c) for c in fields))

    return one.withColumn("samples", F.transform("s", make)).withColumn("ALT", F.split("ALT", ",")).drop("s")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(INTERVALS.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested layout with several ALTs and all kinds of genotypes; ID at every third site; FILTER q20, PASS, or none above 90."""
    one = spread(sites(spark, sf_dir)).withColumn("n_alt", F.when(F.col("site_id") % 6 == 0, 2).otherwise(1))
    kinds = F.when(F.col("n_alt") == 2, F.array(*map(F.lit, KINDS))).otherwise(F.array(*map(F.lit, ONE_ALT)))
    place = F.array(*(F.expr(RH.replace("sample_id", str(i))).cast("int") for i in range(N_SAMPLES)))
    samples = F.transform(place, lambda h, i: F.struct(i.alias("sample_id"), F.get(F.col("_kinds"), h).alias("GT")))
    one = one.withColumns({"_kinds": kinds, "ID": F.when(F.col("site_id") % 3 == 0, F.concat(F.lit("rs"), "site_id")), "FILTER": F.when(F.col("QUAL").isNull() | (F.col("QUAL") > 90), F.array().cast("array<string>")).when(F.col("QUAL") < 20, F.array(F.lit("q20"))).otherwise(F.array(F.lit("PASS")))})
    alts = F.when(F.col("n_alt") == 2, F.array("ALT", F.concat("ALT", F.lit("TT")))).otherwise(F.array("ALT"))
    return one.withColumn("samples", samples).withColumn("ALT", alts).drop("_kinds", "n_alt")


def rich_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rich(spark, sf_dir).select("site_id", "CHROM", "POS", "REF", "ALT", "QUAL", F.inline("samples"))
