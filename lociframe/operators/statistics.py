"""Statistics of call sets as sections of counters, which merge.

A statistics table has the columns of COLUMNS: a section, a key within it (sample, substitution, tag; "" where there is none), a bin
(0 where there is none), a counter and its value. Every value is a sum over records, so tables of parts of a call set, of contigs or
of files add up to the table of the whole, in any order: ratios, rates and correlations are taken by the functions that read a
table, never stored. Tables are small (bins and samples, not sites) and are written and read as Parquet.

Sections: SN, TSTV, ST, QUAL, IDD, USR, FS of sites; PSC, PSI of samples; GCTs, GCTi, GCsAF, GCiAF of two sets that are compared.
All functions take the nested layout (ALT an array, samples an array of structs) with an empty table giving an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions import variants as V
from lociframe.operators.joins import SITE_KEY, overlap_aggregates

COLUMNS = ["section", "key", "bin", "counter"]
UserTag = tuple[str, Column | str, float, float, int]  # name, value or its column, lowest, highest, bins


def cell(section: str | Column, counter: str | Column, key: str | Column = "", bin: int | Column = 0) -> Column:
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(of(section).alias("section"), of(key).cast("string").alias("key"), of(bin).cast("int").alias("bin"), of(counter).alias("counter"))


def counted(rows: DataFrame, *cells: Column) -> DataFrame:
    """The statistics table of rows, each adding 1 to every cell of its arrays; null cells don't count. Combines in the map side."""
    return rows.select(F.inline(F.array_compact(F.concat(*cells)))).groupBy(*COLUMNS).agg(F.count("*").alias("n"))


def merged(*tables: DataFrame) -> DataFrame:
    """The statistics table of all parts together."""
    return reduce(DataFrame.unionByName, tables).groupBy(*COLUMNS).agg(F.sum("n").alias("n"))


# --- sections of sites


def _typed(sites: DataFrame) -> DataFrame:
    """_x: an (a, t) for each ALT."""
    return sites.withColumn("_x", F.transform("ALT", lambda a: F.struct(a.alias("a"), V.allele_type(F.col("REF"), a).alias("t"))))


def _has(*names: str) -> Column:
    return F.exists("_x", lambda x: x["t"].isin(*names))


def _change(x: Column) -> Column:
    """ts or tv of a SNP; null for other letters than ACGT."""
    return F.when(F.concat(F.col("REF"), x["a"]).rlike("^[ACGTacgt]{2}$"), F.when(V.is_transition(F.col("REF"), x["a"]), "ts").otherwise("tv"))


def _changes(make) -> Column:
    return F.transform(F.filter("_x", lambda x: x["t"] == "snp"), lambda x: V.let(_change(x), lambda c: F.when(c.isNotNull(), make(x, c))))


def user_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin of a value: the first at or below low, the last at or above high, the others of equal width between."""
    v = value.cast("double")
    return F.when(v <= low, 0).when(v >= high, bins - 1).otherwise(F.floor((v - low) / (high - low) * (bins - 1)).cast("int"))


def site_sections(sites: DataFrame, user: Iterable[UserTag] = ()) -> DataFrame:
    """SN, TSTV, ST, QUAL and IDD of sites, and USR for every user tag; one pass.

    Counters of SN may overlap. TSTV, ST and USR count SNP alleles, ts_first and tv_first those of the first ALT. QUAL has bins of 0.1
    from bin 1 on; bin 0 has no QUAL or a negative one. IDD has the length change as bin. A tag's null value isn't counted.
    """
    sn = F.array(
        cell("SN", "records"), F.when(F.forall("_x", lambda x: x["t"] == "ref"), cell("SN", "no_alts")), F.when(_has("snp"), cell("SN", "snps")), F.when(_has("mnp"), cell("SN", "mnps")),
        F.when(_has("ins", "del"), cell("SN", "indels")), F.when(_has("other", "bnd", "overlap"), cell("SN", "others")), F.when(F.size("ALT") > 1, cell("SN", "multiallelic")),
        F.when((F.size("ALT") > 1) & F.forall("_x", lambda x: x["t"] == "snp"), cell("SN", "multiallelic_snps")),
    )
    first = V.let(F.get("_x", F.lit(0)), lambda x: F.when(x["t"] == "snp", _change(x)))
    quality = F.when(F.col("QUAL").isNull() | F.isnan(F.col("QUAL").cast("double")) | (F.col("QUAL") < 0), 0).otherwise(1 + F.floor(F.col("QUAL") * 10).cast("int"))
    of_quality = F.array(F.when(_has("snp"), cell("QUAL", "snps", bin=quality)), F.when(_has("ins", "del"), cell("QUAL", "indels", bin=quality)))
    indels = F.transform(F.filter("_x", lambda x: x["t"].isin("ins", "del")), lambda x: V.let(V.indel_length(F.col("REF"), x["a"]), lambda n: F.when(n.isNotNull(), cell("IDD", "alleles", bin=n))))
    values = [(name, F.col(v) if isinstance(v, str) else v, *bins) for name, v, *bins in user]
    tags = [_changes(lambda x, c, tag=tag: F.when(tag[1].isNotNull(), cell("USR", c, tag[0], user_bin(*tag[1:])))) for tag in values]
    return counted(
        _typed(sites), sn, _changes(lambda x, c: cell("TSTV", c)), F.array(V.let(first, lambda c: F.when(c.isNotNull(), cell("TSTV", F.concat(c, F.lit("_first")))))),
        _changes(lambda x, c: cell("ST", "alleles", F.upper(F.concat(F.col("REF"), F.lit(">"), x["a"])))), of_quality, indels, *tags,
    )


def _framed(sites: DataFrame, exons: DataFrame) -> DataFrame:
    """Records with an indel, with _x of (a, t, frame): in, out or na, by how many bases change within the exon that POS lies in.

    Of several exons the one that begins first counts. An insertion after an exon's last base changes none of it; of a deletion the
    bases beyond the exon's end don't count. Only places, each once, and no pairs of them and exons are made.
    """
    rows = _typed(sites).where(_has("ins", "del"))
    at = rows.select(F.col("CHROM").alias("c"), F.col("POS").alias("b"), F.col("POS").alias("e")).distinct()
    end = overlap_aggregates(at, exons.select("c2", "b2", "e2", F.struct("b2", "e2").alias("_x")), {"_x": F.min})
    end = end.select(F.col("c").alias("CHROM"), F.col("b").alias("POS"), F.col("_x.e2").alias("_end"))
    rows = rows.join(end, ["CHROM", "POS"], "left")
    left = F.col("_end") - F.col("POS")  # bases of the exon after POS

    def frame(x: Column) -> Column:
        n = V.indel_length(F.col("REF"), x["a"])
        inside = F.when(left.isNull(), 0).when(n > 0, F.when(left > 0, n).otherwise(0)).otherwise(F.least(-n, left))
        return F.when(x["t"].isin("ins", "del") & (inside > 0), F.when(inside % 3 == 0, "in").otherwise("out")).otherwise("na")

    return rows.withColumn("_x", F.transform("_x", lambda x: x.withField("frame", frame(x))))


def frame_section(sites: DataFrame, exons: DataFrame) -> DataFrame:
    """FS: indel alleles in frame, out of frame or without an exon, of all ALTs and (_first) of first ones. exons: c2, b2, e2, closed."""
    alleles = F.transform("_x", lambda x, i: F.when(x["t"].isin("ins", "del"), F.array(cell("FS", x["frame"]), F.when(i == 0, cell("FS", F.concat(x["frame"], F.lit("_first")))))))
    return counted(_framed(sites, exons), F.flatten(F.array_compact(alleles)))


# --- sections of samples


def _long(rows: DataFrame, section: str, counters: dict[str, Column]) -> DataFrame:
    """Sums of counters over rows (sample_id, ...), a row for each sample and counter."""
    sums = rows.groupBy("sample_id").agg(*(F.sum(c.cast("long")).alias(name) for name, c in counters.items()))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(section).alias("section"), F.col("sample_id").cast("string").alias("key"), F.lit(0).alias("bin"), F.lit(name).alias("counter"), F.coalesce(name, F.lit(0).cast("long")).alias("n")) for name in counters))))


HET, DIPLOID_ALT = ("het_ref", "het_alt"), ("het_ref", "het_alt", "hom_alt")


def _called(s: Column) -> Column:
    """k, the class of the sample's genotype, and called, the (a, t) of its ALT alleles, each once."""
    called = F.transform(F.filter(F.array_distinct(V.alleles(s["GT"])), lambda a: a > 0), lambda a: F.get(F.col("_x"), a - 1))
    return F.struct(s["sample_id"].alias("sample_id"), V.genotype_class(s["GT"]).alias("k"), called.alias("called"), s["GT"].alias("GT"))


def sample_section(nested: DataFrame, depth: str | None = None) -> DataFrame:
    """PSC of the samples: ref_hom, nonref_hom and hets (with a SNP allele), ts, tv (alleles of diploid genotypes, each once), indels
    (diploid genotypes with one), singletons (sites where no other diploid genotype differs from REF), hap_ref, hap_alt, missing; and
    the sum and number of positive depths, from the field named."""
    one = lambda s: _called(s).withField("dp", s[depth] if depth else F.lit(None).cast("int"))
    rows = _typed(nested).withColumn("_s", F.transform("samples", one)).withColumn("_alone", F.size(F.filter("_s", lambda s: s["k"].isin(*DIPLOID_ALT))) == 1)
    rows = rows.select("REF", "_alone", F.inline("_s"))
    k, two, dp = F.col("k"), F.col("k").isin(*DIPLOID_ALT), F.col("dp")
    of = lambda *names: F.exists("called", lambda x: x["t"].isin(*names))
    changed = lambda kind: F.when(two, F.size(F.filter("called", lambda x: (x["t"] == "snp") & (_change(x) == kind)))).otherwise(0)
    return _long(rows, "PSC", {
        "ref_hom": k == "hom_ref", "nonref_hom": (k == "hom_alt") & of("snp"), "hets": k.isin(*HET) & of("snp"), "ts": changed("ts"), "tv": changed("tv"), "indels": two & of("ins", "del"),
        "singletons": F.col("_alone") & two, "hap_ref": k == "hap_ref", "hap_alt": k == "hap_alt", "missing": k == "mis", "depth": F.when(dp > 0, dp), "n_depth": dp > 0,
    })


def sample_indel_section(nested: DataFrame, exons: DataFrame) -> DataFrame:
    """PSI of the samples, over records with an indel.

    in, out and na count alleles of genotypes with an indel allele by its frame; their other alleles are na. ins_hets, del_hets,
    ins_homs and del_homs count diploid genotypes; one of two different ALTs, an insertion and a deletion, counts as both.
    """
    framed = lambda s: F.transform(V.alleles(s["GT"]), lambda a: F.when(a > 0, F.get(F.col("_x"), a - 1)["frame"]).otherwise("na"))
    rows = _framed(nested, exons).select(F.inline(F.transform("samples", lambda s: _called(s).withField("frames", framed(s)))))
    of = lambda *names: F.exists("called", lambda x: x["t"].isin(*names))
    counts = (F.col("k") != "mis") & of("ins", "del")
    frames = {name: F.when(counts, F.size(F.filter("frames", lambda x: x == name))).otherwise(0) for name in ("in", "out", "na")}
    het, hom = F.col("k").isin(*HET), F.col("k") == "hom_alt"
    return _long(rows, "PSI", frames | {"ins_hets": het & of("ins"), "del_hets": het & of("del"), "ins_homs": hom & of("ins"), "del_homs": hom & of("del")})


# --- sections of two sets


#: classes of genotypes: the name in counters, the dosage, and whether it is diploid
CLASSES = {"hom_ref": ("rr", 0, True), "het_ref": ("ra", 1, True), "hom_alt": ("aa", 2, True), "het_alt": ("ab", 2, True), "hap_ref": ("r", 0, False), "hap_alt": ("a", 1, False), "mis": ("x", 0, True)}


def pair_sections(first: DataFrame, second: DataFrame, frequency: Column, keys: list[str] = SITE_KEY, bins: int = 100) -> DataFrame:
    """GCTs and GCTi, by sample, and GCsAF and GCiAF, by bins of `frequency` (of the first set's columns): how often genotype classes
    of two sets meet at records with equal keys, for records with a SNP and for others. A counter is "class>class".

    Samples meet by sample_id; rows of the same roster are zipped. Records whose frequency is null are in bin 0.
    """
    b = F.when(frequency.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(frequency * bins).cast("int"))))
    left = _typed(first).select(*keys, _has("snp").alias("_snp"), b.alias("_b"), F.col("samples").alias("_s1"))
    rows = left.join(second.select(*keys, F.col("samples").alias("_s2")), keys)
    pair = lambda s, t: F.struct(s["sample_id"].alias("id"), V.genotype_class(s["GT"]).alias("k1"), V.genotype_class(t["GT"]).alias("k2"))
    ids = lambda c: F.transform(c, lambda s: s["sample_id"])
    found = F.transform("_s1", lambda s: V.let(F.filter("_s2", lambda t: t["sample_id"] == s["sample_id"]), lambda t: F.when(F.size(t) > 0, pair(s, F.get(t, F.lit(0))))))
    pairs = F.when(ids("_s1") == ids("_s2"), F.zip_with("_s1", "_s2", pair)).otherwise(F.array_compact(found))
    names = F.create_map(*(F.lit(x) for k, v in CLASSES.items() for x in (k, v[0])))
    rows = rows.select("_snp", "_b", F.inline(pairs))
    kind, counter = F.when(F.col("_snp"), "s").otherwise("i"), F.concat(names[F.col("k1")], F.lit(">"), names[F.col("k2")])
    return counted(rows, F.array(cell(F.concat(F.lit("GCT"), kind), counter, F.col("id")), cell(F.concat(F.lit("GC"), kind, F.lit("AF")), counter, bin=F.col("_b"))))


# --- reading a table


def wide(table: DataFrame, section: str, counters: list[str], by: str = "key") -> DataFrame:
    """A section with a column for each counter, 0 where it is absent."""
    return table.where(F.col("section") == section).groupBy(by).agg(*(F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("n"))), F.lit(0)).alias(c) for c in counters))


def user_histogram(table: DataFrame, tag: str, low: float, high: float, bins: int) -> DataFrame:
    """value, snps, ts, tv: the SNPs of a user tag's bins that aren't empty; value is where a bin begins."""
    per = wide(table.where(F.col("key") == tag), "USR", ["ts", "tv"], "bin")
    return per.select((low + (high - low) * F.col("bin") / (bins - 1)).alias("value"), (F.col("ts") + F.col("tv")).alias("snps"), "ts", "tv")


def frames(table: DataFrame) -> DataFrame:
    """in, out, na and the share of out in both, for all ALTs and for first ones; one row."""
    per = wide(table, "FS", ["in", "out", "na", "in_first", "out_first", "na_first"], "section").drop("section")
    share = lambda i, o: F.when(F.col(i) + F.col(o) > 0, F.col(o) / (F.col(i) + F.col(o))).otherwise(0.0)
    return per.withColumns({"out_share": share("in", "out"), "out_share_first": share("in_first", "out_first")})


def sample_counts(table: DataFrame) -> DataFrame:
    """PSC as a row for each sample, with the mean depth."""
    names = ["ref_hom", "nonref_hom", "hets", "ts", "tv", "indels", "singletons", "hap_ref", "hap_alt", "missing", "depth", "n_depth"]
    per = wide(table, "PSC", names).withColumnRenamed("key", "sample")
    return per.withColumn("mean_depth", F.when(F.col("n_depth") > 0, F.col("depth") / F.col("n_depth")).otherwise(0.0)).drop("depth", "n_depth")


def sample_indels(table: DataFrame) -> DataFrame:
    """PSI as a row for each sample, with the share of out in in and out."""
    per = wide(table, "PSI", ["in", "out", "na", "ins_hets", "del_hets", "ins_homs", "del_homs"]).withColumnRenamed("key", "sample")
    return per.withColumn("out_share", F.when(F.col("in") + F.col("out") > 0, F.col("out") / (F.col("in") + F.col("out"))).otherwise(0.0))


def concordance(table: DataFrame, by: str = "sample") -> DataFrame:
    """kind (snps, indels), sample or bin, matches and mismatches of rr, ra and aa by the first set's class, nrd, r2 and n.

    nrd is the percentage of mismatches among all but rr matches. Both ways count rr, ra and aa, by frequency genotypes of two different
    ALTs too; missing ones never count. Haploid classes count as rr and aa. r2 is the squared correlation of dosages over
    the n pairs that are both called and of one ploidy, null where either doesn't vary.
    """
    sections = {"sample": ("GCTs", "GCTi"), "frequency": ("GCsAF", "GCiAF")}[by]
    group = {"sample": F.col("key").alias("sample"), "frequency": F.col("bin")}[by]
    of = lambda place, value: F.create_map(*(F.lit(x) for name, dose, two in CLASSES.values() for x in (name, value(name, dose, two))))[F.split("counter", ">")[place]]
    plain = lambda name, dose, two: {"r": "rr", "a": "aa"}.get(name, name)
    cols = {"c1": of(0, plain), "c2": of(1, plain), "d1": of(0, lambda n, d, t: d), "d2": of(1, lambda n, d, t: d), "same": of(0, lambda n, d, t: t) == of(1, lambda n, d, t: t), "seen": ~F.col("counter").contains("x")}
    t = table.where(F.col("section").isin(*sections)).select(F.when(F.col("section") == sections[0], "snps").otherwise("indels").alias("kind"), group, "n", *(c.alias(name) for name, c in cols.items()))
    known = ["rr", "ra", "aa"] if by == "sample" else ["rr", "ra", "aa", "ab"]
    counts = F.col("c1").isin(*known) & F.col("c2").isin(*known)
    total = lambda when, value=F.lit(1): F.coalesce(F.sum(F.when(when, F.col("n") * value)), F.lit(0))
    agree, pair = F.col("c1") == F.col("c2"), F.col("seen") & F.col("same")
    per = t.groupBy("kind", "sample" if by == "sample" else "bin").agg(
        *(total(counts & agree & (F.col("c1") == c)).alias(f"{c}_match") for c in ("rr", "ra", "aa")), *(total(counts & ~agree & (F.col("c1") == c)).alias(f"{c}_mismatch") for c in ("rr", "ra", "aa")),
        total(counts & ~agree).alias("_x"), total(counts & agree & (F.col("c1") != "rr")).alias("_m"), total(pair).alias("n"), total(pair, F.col("d1")).alias("_1"), total(pair, F.col("d2")).alias("_2"),
        total(pair, F.col("d1") * F.col("d1")).alias("_11"), total(pair, F.col("d2") * F.col("d2")).alias("_22"), total(pair, F.col("d1") * F.col("d2")).alias("_12"),
    )
    n = F.col("n").cast("double")
    spread = lambda a: n * F.col(f"_{a}{a}") - F.col(f"_{a}").cast("double") * F.col(f"_{a}")
    shared = n * F.col("_12") - F.col("_1").cast("double") * F.col("_2")
    rate = F.when(F.col("_x") + F.col("_m") > 0, 100.0 * F.col("_x") / (F.col("_x") + F.col("_m"))).otherwise(0.0)
    r2 = F.when((spread(1) > 0) & (spread(2) > 0), shared * shared / (spread(1) * spread(2)))
    return per.withColumns({"nrd": rate, "r2": r2}).drop("_x", "_m", "_1", "_2", "_11", "_22", "_12")
