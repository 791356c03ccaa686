"""Record-level transforms: splitting and joining alleles, genotype editing, likelihood scales, layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions import variants as V
from lociframe.operators import alleles


def split_alleles(sites: DataFrame) -> DataFrame:
    """A row per ALT allele with its number; ALT is an array before and text after."""
    return sites.select(*[c for c in sites.columns if c != "ALT"], F.posexplode("ALT").alias("_i", "ALT")).withColumn("allele", F.col("_i") + 1).drop("_i")


def join_alleles(rows: DataFrame, keys: list[str], repeated: bool = False) -> DataFrame:
    """Biallelic rows of a site as one, ALT alleles sorted: each once, or with `repeated` once for each different QUAL it has."""
    if repeated:
        rows = rows.select(*keys, "ALT", "QUAL").distinct()
    return rows.groupBy(*keys).agg(F.array_sort((F.collect_list if repeated else F.collect_set)("ALT")).alias("ALT"), F.max("QUAL").alias("QUAL"))


def remapped(gt: Column, allele: Column) -> Column:
    """Genotype after a split: allele becomes 1, REF stays 0, other ALTs become missing."""
    return F.array_join(F.transform(V.alleles(gt), lambda a: F.when(a == 0, "0").when(a == allele, "1").otherwise(".")), "/")


def split_genotypes(nested: DataFrame) -> DataFrame:
    """A row per ALT allele with its number, and genotypes that tell it from REF: it becomes 1, REF stays 0, other ALTs are
    missing; separators stay. ALT is text after. Lists by alleles keep its values, other sample fields stay."""
    rows = alleles.split_records(nested.where(F.size("ALT") > 0))
    return rows.withColumn("ALT", F.get("ALT", F.lit(0)))


#: Values of a tag by its Number, at a site of n ALTs: one per ALT, per allele, per unphased diploid genotype.
LENGTHS = {"A": lambda n: n, "R": lambda n: n + 1, "G": lambda n: (n + 1) * (n + 2) / 2}


def values_of_allele(values: Column, number: str, allele: Column) -> Column:
    """What a list of Number A, R or G keeps of one ALT allele: its own value, those of REF and it, or those of their three
    genotypes."""
    get = lambda i: F.get(values, i.cast("int"))
    if number == "A":
        return F.array(get(allele - 1))
    if number == "R":
        return F.array(get(F.lit(0)), get(allele))
    if number == "G":
        first = allele * (allele + 1) / 2
        return F.array(get(F.lit(0)), get(first), get(first + allele))
    raise ValueError(f"no list by alleles: {number}")


def trimmed(ref: Column, alt: Column) -> Column:
    """Parsimonious pos shift, REF and ALT: the common suffix goes, then the common prefix, one base stays on both sides."""
    n, m = F.length(ref), F.length(alt)
    short = V.let(V.common(ref, alt, F.least(n, m) - 1, V.base_from_end), lambda x: F.struct(F.substring(ref, F.lit(1), n - x).alias("r"), F.substring(alt, F.lit(1), m - x).alias("a")))

    def cut(x: Column) -> Column:
        r, a = x["r"], x["a"]
        return V.let(V.common(r, a, F.least(F.length(r), F.length(a)) - 1, V.base_at), lambda p: F.struct(p.alias("shift"), F.substring(r, p + 1, n).alias("REF"), F.substring(a, p + 1, m).alias("ALT")))

    return V.let(short, cut)


def atomised(sites: DataFrame) -> DataFrame:
    """Substitutions of several bases as single ones; other rows pass. ALT is text."""
    mnp = (F.length("REF") == F.length("ALT")) & (F.length("REF") > 1)
    base = lambda s, i: F.substring(s, i, F.lit(1))
    atoms = F.filter(F.transform(F.sequence(F.lit(1), F.length("REF")), lambda i: F.struct((F.col("POS") + i - 1).alias("POS"), base(F.col("REF"), i).alias("REF"), base(F.col("ALT"), i).alias("ALT"))), lambda x: x["REF"] != x["ALT"])
    whole = F.array(F.struct(F.col("POS"), F.col("REF"), F.col("ALT")))
    rest = [c for c in sites.columns if c not in ("POS", "REF", "ALT")]
    return sites.select(*rest, F.inline(F.when(mnp, atoms).otherwise(whole)))


def missing_to_ref(gt: Column, phased: bool = False) -> Column:
    return F.when(V.in_class(gt, "mis"), "0|0" if phased else "0/0").otherwise(gt)


def set_genotype(gt: Column, target: Column, new: str) -> Column:
    """Genotypes where target holds become new: "." missing, "0" reference, "p" phased, "u" unphased and sorted, or "c:GT"."""
    n = F.size(V.alleles(gt))
    value = {
        ".": F.array_join(F.array_repeat(F.lit("."), n), "/"), "0": F.array_join(F.array_repeat(F.lit("0"), n), "/"), "p": F.replace(gt, F.lit("/"), F.lit("|")),
        "u": F.array_join(F.array_sort(F.split(gt, "[/|]")), "/"),
    }.get(new) if not new.startswith("c:") else F.lit(new[2:])
    return F.when(target, value).otherwise(gt)


def likelihoods_from_phred(pl: Column) -> Column:
    """PL to log10 likelihoods."""
    return F.transform(pl, lambda x: -x / 10)


def phred_from_likelihoods(gl: Column) -> Column:
    """Log10 likelihoods to PL: the best is 0."""
    return V.let(F.array_max(gl), lambda top: F.transform(gl, lambda x: F.round(-10 * (x - top)).cast("int")))


def probabilities(gl: Column) -> Column:
    """Log10 likelihoods to genotype probabilities that add up to 1."""
    raw = V.let(gl, lambda g: V.let(F.array_max(g), lambda top: F.transform(g, lambda x: F.pow(F.lit(10.0), x - top))))
    return V.let(raw, lambda r: V.let(F.aggregate(r, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(r, lambda x: x / total)))


def dosage_from_probabilities(gp: Column) -> Column:
    """Expected number of ALT alleles of a biallelic diploid site."""
    return gp[1] + 2 * gp[2]


def dosage_from_genotype(gt: Column) -> Column:
    """Number of ALT alleles; null if any is missing."""
    return F.when(~V.in_class(gt, "mis"), F.size(F.filter(V.alleles(gt), lambda x: x > 0)))


def tidy(nested: DataFrame) -> DataFrame:
    """A row per site and sample of the canonical layout."""
    return nested.select(*[c for c in nested.columns if c != "samples"], F.inline("samples"))


def wide(tidy_rows: DataFrame, keys: list[str], field: str, samples: list[int]) -> DataFrame:
    """A column field_sample for every sample of the list."""
    out = tidy_rows.groupBy(*keys).pivot("sample_id", samples).agg(F.first(field))
    return out.select(*keys, *(F.col(str(s)).alias(f"{field}_{s}") for s in samples))


def sample_subset(nested: DataFrame, samples: list[int]) -> DataFrame:
    """The samples listed, in that order, with AC and AN of those left."""
    pick = F.transform(F.array(*map(F.lit, samples)), lambda i: F.filter("samples", lambda s: s["sample_id"] == i)[0])
    calls = F.flatten(F.transform("samples", lambda s: F.filter(V.alleles(s["GT"]), lambda a: a.isNotNull())))
    return nested.withColumn("samples", pick).withColumns({"AC": F.size(F.filter(calls, lambda a: a > 0)), "AN": F.size(calls)})


def without_unused_alts(nested: DataFrame) -> DataFrame:
    """ALTs that no genotype has are dropped; genotypes are renumbered and lists by alleles follow. A site may be left without
    ALT."""
    return alleles.trim_records(nested)


def with_id(sites: DataFrame, text: Column, only_missing: bool = False) -> DataFrame:
    """ID from the site's columns, or only where it has none."""
    return sites.withColumn("ID", F.coalesce("ID", text) if only_missing else text)


def without_fields(sites: DataFrame, *names: str) -> DataFrame:
    """Fields removed: ID and QUAL become missing, FILTER empty, FILTER/x loses x, INFO drops all INFO_ columns, INFO/x one,
    FORMAT/x goes from every sample."""
    for name in names:
        kind, _, part = name.partition("/")
        if kind in ("ID", "QUAL"):
            sites = sites.withColumn(kind, F.lit(None).cast(sites.schema[kind].dataType))
        elif kind == "FILTER":
            sites = sites.withColumn("FILTER", F.array_remove("FILTER", part) if part else F.array().cast("array<string>"))
        elif kind == "INFO":
            sites = sites.drop(*([f"INFO_{part}"] if part else [c for c in sites.columns if c.startswith("INFO_")]))
        elif kind == "FORMAT" and part:
            sites = sites.withColumn("samples", _without_sample_field(part))
        else:
            raise ValueError(f"no such field: {name}")
    return sites


def _without_sample_field(name: str) -> Column:
    return F.transform("samples", lambda s: s.dropFields(name))


def with_contigs(sites: DataFrame, names: dict[str, str]) -> DataFrame:
    """Contigs renamed; names is as long as the header's list of contigs."""
    new = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return sites.withColumn("CHROM", F.coalesce(F.try_element_at(new, F.col("CHROM")), "CHROM")) if names else sites
