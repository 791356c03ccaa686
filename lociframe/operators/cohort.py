"""Cohort-level checks, comparisons of two call sets, and genotype repair. Tidy rows unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions import variants as V
from lociframe.operators import alleles
from lociframe.operators.aggregates import fisher_test

COMPLEMENT = ("ACGTacgt", "TGCAtgca")


def masked_differences(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Genotypes of first, missing where second has another one. Sites that second lacks stay as they are."""
    other = second.select(*keys, F.col("GT").alias("_gt"))
    return first.join(other, keys, "left").withColumn("GT", F.when(F.col("_gt").isNull() | (F.col("_gt") == F.col("GT")), F.col("GT")).otherwise("./.")).drop("_gt")


def exclusive_genotype(nested: DataFrame, samples: list[int]) -> DataFrame:
    """Sites where the samples share one called genotype that no other sample has. Reads each site's own array."""
    own = F.array_distinct(F.transform(F.filter("samples", lambda s: s["sample_id"].isin(samples)), lambda s: s["GT"]))
    rest = F.transform(F.filter("samples", lambda s: ~s["sample_id"].isin(samples)), lambda s: s["GT"])
    return nested.where((F.size(own) == 1) & ~V.in_class(own[0], "mis") & ~F.array_contains(rest, own[0]))


def genotype_table(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """How often each pair of genotypes occurs at common sites and samples: the basis of discordance rates."""
    return first.join(second.select(*keys, F.col("GT").alias("gt2")), keys).groupBy(F.col("GT").alias("gt1"), "gt2").agg(F.count("*").alias("n"))


def discordance(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Non-reference discordance: pairs that differ over pairs that are not both homozygous reference; missing ones aside."""
    t = genotype_table(first, second, keys).where("gt1 <> './.' and gt2 <> './.'")
    differ = F.sum(F.when(F.col("gt1") != F.col("gt2"), F.col("n")).otherwise(0))
    either = F.sum(F.when((F.col("gt1") != "0/0") | (F.col("gt2") != "0/0"), F.col("n")).otherwise(0))
    return t.agg(differ.alias("n_differ"), either.alias("n_nonref"), (differ / either).alias("nrd"))


def merged_samples(first: DataFrame, second: DataFrame, site: list[str], missing: str = "./.") -> DataFrame:
    """Samples of both sets at the sites of either, in tidy rows: a sample's genotype is `missing` at sites its set lacks.

    Second's samples are renumbered after first's where their numbers clash.
    """
    tagged = first.select(*site, F.lit(1).alias("s"), "sample_id", "GT").unionByName(second.select(*site, F.lit(2).alias("s"), "sample_id", "GT"))
    roster = tagged.select("s", "sample_id").distinct().orderBy("s", "sample_id").collect()  # as long as the cohort's sample list
    if not roster:
        return tagged.select(*site, F.col("sample_id").cast("int").alias("sample_id"), "GT")
    schema = f"s int, sample_id {tagged.schema['sample_id'].dataType.simpleString()}, n int"
    numbers = first.sparkSession.createDataFrame([(r.s, r.sample_id, n) for n, r in enumerate(roster)], schema)
    rows = tagged.join(F.broadcast(numbers), ["s", "sample_id"]).select(*site, F.col("n").alias("sample_id"), "GT")
    # genotypes stay where they are; only sample numbers meet, for those that a site lacks
    everyone = F.sequence(F.lit(0), F.lit(len(roster) - 1))
    gaps = rows.groupBy(*site).agg(F.collect_list("sample_id").alias("_has")).select(*site, F.explode(F.array_except(everyone, "_has")).alias("sample_id"), F.lit(missing).alias("GT"))
    return rows.unionByName(gaps)


def ploidy(tidy: DataFrame, *keys: str) -> DataFrame:
    """Genotypes by number of alleles; missing ones aside."""
    return tidy.where(~V.in_class(F.col("GT"), "mis")).groupBy(*keys, F.size(V.alleles(F.col("GT"))).alias("ploidy")).agg(F.count("*").alias("n"))


def sparse_samples(tidy: DataFrame, least: int) -> DataFrame:
    """Samples and contigs with fewer called genotypes than `least`."""
    called = F.count_if(~V.in_class(F.col("GT"), "mis"))
    return tidy.groupBy("sample_id", "CHROM").agg(called.alias("n_called")).where(F.col("n_called") < least)


def sparse_share(tidy: DataFrame, share: float) -> DataFrame:
    """Samples and contigs with called genotypes at less than `share` of the contig's sites, those without any row too."""
    called = F.count_if(~V.in_class(F.col("GT"), "mis"))
    have = tidy.groupBy("sample_id", "CHROM").agg(called.alias("n_called"))
    contigs = tidy.groupBy("CHROM").agg(F.count_distinct("site_id").alias("n_sites"))
    full = tidy.select("sample_id").distinct().crossJoin(contigs).join(have, ["sample_id", "CHROM"], "left")
    return full.withColumn("n_called", F.coalesce("n_called", F.lit(0))).where(F.col("n_called") < share * F.col("n_sites")).select("sample_id", "CHROM", "n_called", "n_sites")


def imputation_quality(nested: DataFrame, probabilities) -> DataFrame:
    """INFO metric of a biallelic site: 1 - mean genotype variance over its expectation; 1 for a monomorphic site.
    probabilities maps a sample struct to its array of three genotype probabilities."""
    moments = F.transform("samples", lambda s: V.let(probabilities(s), lambda p: F.struct((p[1] + 2 * p[2]).alias("e"), (p[1] + 4 * p[2]).alias("f"))))
    df = alleles.fixed(nested, _m=moments)
    total = lambda name: F.aggregate("_m", F.lit(0.0), lambda a, x: a + x[name])
    n = F.size("_m")
    df = alleles.fixed(df, theta=total("e") / (2 * n))
    spread = F.aggregate("_m", F.lit(0.0), lambda a, x: a + x["f"] - x["e"] * x["e"])
    return df.withColumn("info", F.when((F.col("theta") > 0) & (F.col("theta") < 1), 1 - spread / (2 * n * F.col("theta") * (1 - F.col("theta")))).otherwise(1.0)).drop("_m")


def allele_bias(nested: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Fisher's test of reads of REF and ALT between two samples, for pairs of samples of a site."""
    ad = lambda i: F.filter("samples", lambda s: s["sample_id"] == i)[0]["AD"]
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), ad(a)[0].alias("x1"), ad(a)[1].alias("x2"), ad(b)[0].alias("x3"), ad(b)[1].alias("x4")) for a, b in pairs))
    t = nested.select("site_id", F.inline(rows))
    tab = ["x1", "x2", "x3", "x4"]
    return t.join(t.select(*tab).distinct().withColumn("p", fisher_test(*tab)), tab).drop(*tab)


def frameshifts(sites: DataFrame, exons: DataFrame) -> DataFrame:
    """Indels within exons, with out_of_frame. sites: site_id, CHROM, POS, REF, ALT; exons: c2, b2, e2."""
    from lociframe.operators.joins import overlap_join

    left = sites.where(F.length("REF") != F.length("ALT")).select("site_id", F.col("CHROM").alias("c"), F.col("POS").alias("b"), (F.col("POS") + F.length("REF") - 1).alias("e"), ((F.length("ALT") - F.length("REF")) % 3 != 0).alias("out_of_frame"))
    spans = ["c", "b", "e"]  # indels of one span, and exons of one, meet once
    hit = overlap_join(left.select(*spans).distinct(), exons.select("c2", "b2", "e2").distinct(), 64).select(*spans).distinct()
    return left.join(hit, spans, "left_semi").select("site_id", "out_of_frame").distinct()


def ploidy_likelihood(tidy: DataFrame, frequency: Column, error: float = 1e-3) -> DataFrame:
    """Per sample: log10 likelihoods of its genotypes as diploid and as haploid, with allele frequency f and error rate."""
    f = frequency
    like = lambda rr, ra, aa: (F.log10(rr * (1 - f) * (1 - f) + ra * 2 * f * (1 - f) + aa * f * f), F.log10(rr * (1 - f) + aa * f))
    e = F.lit(error)
    p = {"0/0": (1 - 2 * e, e, e), "0/1": (e, 1 - 2 * e, e), "1/1": (e, e, 1 - 2 * e)}
    dip = hap = None
    for gt, probs in p.items():
        d, h = like(*probs)
        dip = F.when(F.col("GT") == gt, d) if dip is None else dip.when(F.col("GT") == gt, d)
        hap = F.when(F.col("GT") == gt, h) if hap is None else hap.when(F.col("GT") == gt, h)
    return tidy.where("GT <> './.'").groupBy("sample_id").agg(F.sum(dip).alias("diploid"), F.sum(hap).alias("haploid"))


def with_ploidy(gt: Column, n: Column) -> Column:
    """Genotype padded with its last allele, or cut, to n alleles."""
    a = F.split(gt, "[/|]")
    return F.array_join(F.slice(F.concat(a, F.array_repeat(F.element_at(a, -1), n)), F.lit(1), n), "/")


def strand_fix(sites: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """fix: none where REF is the reference base, swap where ALT is, flip or flip_swap where the complement is, else fail.
    reference: keys, base."""
    flip = lambda c: F.translate(c, *COMPLEMENT)
    b = F.col("base")
    fix = F.when(F.col("REF") == b, "none").when(F.col("ALT") == b, "swap").when(flip(F.col("REF")) == b, "flip").when(flip(F.col("ALT")) == b, "flip_swap").otherwise("fail")
    return sites.join(reference, keys).withColumn("fix", fix)


def renamed(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns of summary statistics by their standard names; letter case is ignored and the first alias found counts."""
    low = {c.lower(): c for c in df.columns}
    picked = {name: next((low[a.lower()] for a in [name, *others] if a.lower() in low), None) for name, others in aliases.items()}
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in picked.items() if c))


def scattered(sites: DataFrame, width: int) -> DataFrame:
    """chunk: contig and number of the stretch of `width` positions, the name of an output partition."""
    return sites.withColumn("chunk", F.concat_ws("_", "CHROM", F.floor((F.col("POS") - 1) / width).cast("string")))


def checked_ref(sites: DataFrame, reference: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """Sites against the reference base. w: all, with ref_ok; x: those that agree; s: REF set to the base, with REF and ALT
    swapped if ALT is it, and genotypes and lists by alleles with them in the nested layout; e: an error in the job if any disagrees. reference: keys, base. ALT is text."""
    t = sites.join(reference, keys).withColumn("ref_ok", F.upper("REF") == F.upper("base"))
    if mode == "w":
        return t.drop("base")
    if mode == "x":
        return t.where("ref_ok").drop("base", "ref_ok")
    if mode == "s":
        swap = ~F.col("ref_ok") & (F.upper("ALT") == F.upper("base"))
        if "samples" in sites.columns:
            order = F.when(F.coalesce(swap, F.lit(False)), F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
            t = alleles.with_alleles(t.withColumns({"_order": order, "_n": F.lit(2)}), "_order", "_n")
        alt = F.when(swap, F.col("REF")).otherwise(F.col("ALT"))
        return t.withColumn("ALT", alt).withColumn("REF", F.when(F.col("ref_ok"), F.col("REF")).otherwise(F.col("base"))).drop("base", "ref_ok")
    if mode == "e":
        return t.where(F.when(F.col("ref_ok"), True).otherwise(F.raise_error(F.concat(F.lit("REF differs from the reference at "), F.concat_ws(":", *keys))).cast("boolean"))).drop("base", "ref_ok")
    raise ValueError(f"no such mode: {mode}")
