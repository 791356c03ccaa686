"""Selection of sites by what they are and by what their samples carry; sites in the nested layout.

All but targets are predicates over a site's own columns and array of samples: they shuffle nothing, and those on columns
reach the scan. Counts cover all samples of the array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions import variants as V

KINDS = ("nref", "alt1", "minor", "major", "nonmajor")


def filtered(names: list[str]) -> Column:
    """FILTER has one of the names; "." stands for no filter at all."""
    hit = F.arrays_overlap("FILTER", F.array(*map(F.lit, names)))
    return F.coalesce(hit, F.lit(False)) | (F.size("FILTER") == 0) if "." in names else F.coalesce(hit, F.lit(False))


def known() -> Column:
    """The site has an ID; its negation gives the novel ones."""
    return F.col("ID").isNotNull()


def allele_number(least: int | None = None, most: int | None = None) -> Column:
    """REF and ALT alleles together number at least and at most so many."""
    n = F.size("ALT") + 1
    return (n >= (least or 0)) & (n <= most if most is not None else F.lit(True))


def of_type(*kinds: str) -> Column:
    """Any ALT is a snp, mnp, indel, other, bnd, overlap or ref."""
    found = F.transform(V.types(F.col("REF"), F.col("ALT")), lambda t: F.when(t.isin("ins", "del"), "indel").otherwise(t))
    return F.arrays_overlap(found, F.array(*map(F.lit, kinds)))


def allele_counts() -> Column:
    """Calls of REF and of each ALT over the samples."""
    calls = F.flatten(F.transform("samples", lambda s: V.alleles(s["GT"])))
    return V.let(calls, lambda c: F.transform(F.sequence(F.lit(0), F.size("ALT")), lambda i: F.size(F.filter(c, lambda x: x == i))))


def _count(counts: Column, kind: str) -> Column:
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    if kind not in KINDS:
        raise ValueError(f"no such count: {kind}")
    return {
        "nref": lambda: total(F.slice(counts, F.lit(2), F.size(counts))), "alt1": lambda: F.coalesce(F.get(counts, F.lit(1)), F.lit(0)), "minor": lambda: F.array_min(counts),
        "major": lambda: F.array_max(counts), "nonmajor": lambda: total(counts) - F.array_max(counts),
    }[kind]()


def count_between(least: int | None, most: int | None, kind: str = "nref") -> Column:
    """Allele count of a kind (nref: all ALTs, alt1: the first, minor and major over all alleles, nonmajor) in a range."""
    return V.let(allele_counts(), lambda c: V.let(_count(c, kind), lambda n: (n >= (least or 0)) & (n <= most if most is not None else F.lit(True))))


def frequency_between(least: float | None, most: float | None, kind: str = "nref") -> Column:
    """The same of the count over all calls; false where nothing is called."""

    def test(c: Column) -> Column:
        n = F.aggregate(c, F.lit(0), lambda s, x: s + x)
        return F.when(n > 0, V.let(_count(c, kind) / n, lambda f: (f >= (least or 0.0)) & (f <= most if most is not None else F.lit(True)))).otherwise(False)

    return V.let(allele_counts(), test)


def has_genotype(kind: str) -> Column:
    """Any sample is hom, het or miss."""
    return F.exists("samples", lambda s: V.in_class(s["GT"], {"miss": "mis"}.get(kind, kind)))


def all_phased() -> Column:
    """Every sample's genotype is phased; one of a single allele counts as phased."""
    return F.forall("samples", lambda s: V.is_phased(s["GT"]) | ~s["GT"].rlike("[/|]"))


def uncalled() -> Column:
    """No sample has a called allele."""
    return F.forall("samples", lambda s: F.forall(V.alleles(s["GT"]), lambda a: a.isNull()))


def private_to(samples: list) -> Column:
    """Some of these samples carry an ALT and no other does."""
    carries = lambda s: F.exists(V.alleles(s["GT"]), lambda a: a > 0)
    own = lambda s: s["sample_id"].isin(samples)
    return F.exists("samples", lambda s: own(s) & F.coalesce(carries(s), F.lit(False))) & ~F.exists("samples", lambda s: ~own(s) & F.coalesce(carries(s), F.lit(False)))


def in_targets(sites: DataFrame, regions: DataFrame, overlap: str = "pos", inside: bool = True, bin_size: int = 1024) -> DataFrame:
    """Sites in (or outside) regions (c2, b2, e2; closed, 1-based), by where they overlap: pos: POS; record: the REF allele;
    variant: what the shared first base of an indel leaves of it. Both sides meet by bins, so no contig is one task."""
    begin, end = F.col("POS"), F.col("POS") + F.length("REF") - 1
    if overlap == "pos":
        end = F.col("POS")
    elif overlap == "variant":
        begin = F.when(F.forall("ALT", lambda a: (F.length(a) != F.length("REF")) & (F.substring(a, 1, 1) == F.substring("REF", 1, 1))), F.least(begin + 1, end)).otherwise(begin)
    elif overlap != "record":
        raise ValueError(f"no such overlap: {overlap}")
    cut = lambda b, e: F.sequence(F.floor(b / bin_size), F.floor(e / bin_size))
    placed = sites.withColumns({"_b": begin, "_e": end, "_bins": cut(begin, end)})
    near = regions.select("c2", F.explode(cut(F.col("b2"), F.col("e2"))).alias("_bin"), F.struct("b2", "e2").alias("_r")).groupBy("c2", "_bin").agg(F.collect_list("_r").alias("_near"))
    # a site touches one bin, or few if its REF is long; each of them tells whether a region of its own is met
    keyed = placed.withColumn("_id", F.struct("CHROM", "POS", "REF", "ALT")).select("_id", "_b", "_e", F.col("CHROM").alias("c2"), F.explode("_bins").alias("_bin"))
    hit = keyed.join(near, ["c2", "_bin"]).where(F.exists("_near", lambda r: (F.col("_b") <= r["e2"]) & (r["b2"] <= F.col("_e")))).select("_id").distinct()
    return sites.withColumn("_id", F.struct("CHROM", "POS", "REF", "ALT")).join(hit, "_id", "left_semi" if inside else "left_anti").drop("_id")
