"""Counts and tests over sites and genotypes. All take tidy rows (a row per site and sample) unless they say otherwise."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from lociframe.functions import variants as V


def contig_summary(sites: DataFrame) -> DataFrame:
    return sites.groupBy("CHROM").agg(F.count("*").alias("n"), F.min("POS").alias("min_pos"), F.max("POS").alias("max_pos"), F.countDistinct("POS").alias("n_pos"))


def _counts() -> Column:
    """A struct of what a genotype counts for."""

    def counts(a: Column) -> Column:
        called = F.filter(a, lambda x: x.isNotNull())

        def of(called: Column) -> Column:
            n_alt, n = F.size(F.filter(called, lambda x: x > 0)), F.size(called)
            full, distinct = n == F.size(a), F.size(F.array_distinct(called))
            two = full & (F.size(a) == 2)
            return F.struct(
                n.alias("AN"), n_alt.alias("AC"), (n > 0).cast("int").alias("called"), (full & (distinct > 1)).cast("int").alias("het"),
                F.when(full & (distinct == 1) & (F.size(a) > 1) & (n_alt > 0), n_alt).otherwise(0).alias("hom"), F.when(n == 1, n_alt).otherwise(0).alias("hemi"),
                (two & (n_alt == 0)).cast("int").alias("hom_ref"), (two & (n_alt == 2)).cast("int").alias("hom_alt"),
            )

        return V.let(called, of)

    return V.let(V.alleles(F.col("GT")), counts)


def fill_tags(tidy: DataFrame, *keys: str) -> DataFrame:
    """AN, AC, AF, MAF, NS, F_MISSING, AC_Het, AC_Hom, AC_Hemi of biallelic sites, by keys (site, or site and population).

    AF is 0 where nothing is called; MAF is the frequency of the second most common allele. Integers are summed in the map
    side; no genotype leaves its partition.
    """
    t = tidy.select(*keys, F.inline(F.array(_counts())))
    t = t.groupBy(*keys).agg(F.sum("AN").alias("AN"), F.sum("AC").alias("AC"), F.sum("called").alias("NS"), F.count("*").alias("n"), F.sum("het").alias("AC_Het"), F.sum("hom").alias("AC_Hom"), F.sum("hemi").alias("AC_Hemi"), F.sum("hom_ref").alias("n_hom_ref"), F.sum("hom_alt").alias("n_hom_alt"))
    af = F.when(F.col("AN") > 0, F.col("AC") / F.col("AN")).otherwise(0.0)
    return t.withColumns({"AF": af, "MAF": F.least(af, F.when(F.col("AN") > 0, 1 - af).otherwise(0.0)), "F_MISSING": 1 - F.col("NS") / F.col("n")}).drop("n")


def fill_tags_by_allele(nested: DataFrame) -> DataFrame:
    """Adds AN, NS, MAF, F_MISSING, and arrays over the ALTs: AC, AF, AC_Het, AC_Hom, AC_Hemi. Nested layout.

    Missing alleles are skipped. A genotype of one kind of allele adds 2 to Hom, or 1 to Hemi if a single allele is called,
    haploid or half-missing; one of several kinds adds 1 to Het of each. MAF is of the second most common allele.
    """
    calls = F.transform("samples", lambda s: F.filter(V.alleles(s["GT"]), lambda x: x.isNotNull()))
    alleles = F.sequence(F.lit(0), F.size("ALT"))
    kinds = lambda c: F.size(F.array_distinct(c))

    def tags(c: Column) -> Column:
        number = lambda test: F.size(F.filter(c, test))
        per = lambda i: F.struct(
            F.size(F.filter(F.flatten(c), lambda x: x == i)).alias("ac"), number(lambda g: F.array_contains(g, i) & (kinds(g) > 1)).alias("het"),
            (2 * number(lambda g: F.array_contains(g, i) & (kinds(g) == 1) & (F.size(g) > 1))).alias("hom"), number(lambda g: F.array_contains(g, i) & (F.size(g) == 1)).alias("hemi"),
        )
        return F.struct(F.transform(alleles, per).alias("by"), number(lambda g: F.size(g) > 0).alias("NS"))

    t = nested.select("*", F.inline(F.array(V.let(calls, tags))))
    field = lambda name: F.transform(F.slice("by", F.lit(2), F.size("ALT")), lambda x: x[name])
    n = F.aggregate("by", F.lit(0), lambda s, x: s + x["ac"])
    t = t.withColumns({"AN": n, "AC": field("ac"), "AC_Het": field("het"), "AC_Hom": field("hom"), "AC_Hemi": field("hemi"), "F_MISSING": 1 - F.col("NS") / F.size("samples")})
    second = F.get(F.sort_array(F.transform("by", lambda x: x["ac"]), asc=False), F.lit(1))
    safe = lambda x: F.when(F.col("AN") > 0, x / F.col("AN")).otherwise(0.0)
    return t.withColumns({"MAF": safe(F.coalesce(second, F.lit(0))), "AF": F.transform("AC", safe)}).drop("by")


def _hwe(hom_ref: int, het: int, hom_alt: int) -> tuple[float, float]:
    """Probability of the genotype counts and all less likely ones under Hardy-Weinberg, and of at least as many hets."""
    n, rare = hom_ref + het + hom_alt, min(2 * hom_ref + het, 2 * hom_alt + het)
    if rare == 0:
        return 1.0, 1.0
    lg = math.lgamma
    logs = {h: h * math.log(2) + lg(n + 1) - lg((rare - h) / 2 + 1) - lg(h + 1) - lg(n - h - (rare - h) / 2 + 1) for h in range(rare % 2, rare + 1, 2)}
    top = max(logs.values())
    weight = {h: math.exp(v - top) for h, v in logs.items()}
    total = sum(weight.values())
    own = weight[het]
    return min(1.0, sum(w for w in weight.values() if w <= own * (1 + 1e-9)) / total), sum(w for h, w in weight.items() if h >= het) / total


@F.pandas_udf(StructType().add("hwe", DoubleType()).add("exc_het", DoubleType()))
def hardy_weinberg(hom_ref: pd.Series, het: pd.Series, hom_alt: pd.Series) -> pd.DataFrame:
    """Exact test; each distinct triple of a batch is computed once."""
    known: dict[tuple[int, int, int], tuple[float, float]] = {}
    rows = []
    for k in zip(hom_ref.astype(int), het.astype(int), hom_alt.astype(int), strict=True):
        if k not in known:
            known[k] = _hwe(*k)
        rows.append(known[k])
    return pd.DataFrame(rows, columns=["hwe", "exc_het"])


def _fisher(a: int, b: int, c: int, d: int) -> float:
    lg = math.lgamma
    r1, r2, c1 = a + b, c + d, a + c
    log = lambda x: -(lg(x + 1) + lg(r1 - x + 1) + lg(c1 - x + 1) + lg(r2 - c1 + x + 1))
    logs = {x: log(x) for x in range(max(0, c1 - r2), min(r1, c1) + 1)}
    top = max(logs.values())
    weight = {x: math.exp(v - top) for x, v in logs.items()}
    return min(1.0, sum(w for w in weight.values() if w <= weight[a] * (1 + 1e-7)) / sum(weight.values()))


@F.pandas_udf(DoubleType())
def fisher_test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-tailed exact test of [[a, b], [c, d]]; each distinct table of a batch is computed once."""
    known: dict[tuple, float] = {}
    out = []
    for k in zip(a.astype(int), b.astype(int), c.astype(int), d.astype(int), strict=True):
        if k not in known:
            known[k] = _fisher(*k)
        out.append(known[k])
    return pd.Series(out)


def with_hwe(filled: DataFrame) -> DataFrame:
    """Adds HWE and ExcHet to fill_tags' counts; the distinct triples are far fewer than the sites, and each is tested once."""
    triple = ["n_hom_ref", "AC_Het", "n_hom_alt"]
    tested = filled.select(*triple).distinct().withColumn("t", hardy_weinberg(*triple)).select(*triple, F.col("t.hwe").alias("HWE"), F.col("t.exc_het").alias("ExcHet"))
    return filled.join(tested, triple)


def record_types(sites: DataFrame) -> DataFrame:
    """Counters that may overlap: records, without ALT, SNPs, MNPs, indels, others, multiallelic. ALT is an array."""
    t = sites.withColumn("t", V.types(F.col("REF"), F.col("ALT")))
    has = lambda *names: F.count_if(F.arrays_overlap("t", F.array(*map(F.lit, names))))
    return t.agg(
        F.count("*").alias("records"), F.count_if(F.forall("t", lambda x: x == "ref")).alias("no_alts"), has("snp").alias("snps"), has("mnp").alias("mnps"),
        has("ins", "del").alias("indels"), has("other", "bnd", "overlap").alias("others"), F.count_if(F.size("ALT") > 1).alias("multiallelic"),
    )


def transitions(sites: DataFrame) -> DataFrame:
    snps = _snps(sites)
    ts, tv = F.count_if(V.is_transition(F.col("REF"), F.col("a"))), F.count_if(~V.is_transition(F.col("REF"), F.col("a")))
    return snps.agg(ts.alias("ts"), tv.alias("tv"), (ts / tv).alias("tstv"))


def substitutions(sites: DataFrame) -> DataFrame:
    return _snps(sites).groupBy(F.concat_ws(">", "REF", "a").alias("subst")).count().withColumnRenamed("count", "n")


def _snps(sites: DataFrame) -> DataFrame:
    return sites.withColumn("a", F.explode("ALT")).where(V.allele_type(F.col("REF"), F.col("a")) == "snp")


def indel_lengths(sites: DataFrame) -> DataFrame:
    rows = sites.withColumn("a", F.explode("ALT")).where(V.allele_type(F.col("REF"), F.col("a")).isin("ins", "del"))
    return rows.groupBy(V.indel_length(F.col("REF"), F.col("a")).alias("length")).agg(F.count("*").alias("n"))


def sample_stats(tidy: DataFrame, *more: str) -> DataFrame:
    """Per sample: calls, non-reference, hom ref, hom alt, het, missing, SNVs, indels, ts, tv. REF, ALT biallelic."""
    tidy = tidy.select("*", F.inline(F.array(F.struct(V.genotype_class(F.col("GT")).alias("_k")))))
    k, snp = F.col("_k"), F.length("REF") == F.length("ALT")
    nonref = k.isin("het_ref", "het_alt", "hom_alt", "hap_alt")
    ts = V.is_transition(F.col("REF"), F.col("ALT"))
    return tidy.groupBy(*more, "sample_id").agg(
        F.count_if(k != "mis").alias("n_called"), F.count_if(nonref).alias("n_nonref"), F.count_if(k == "hom_ref").alias("n_hom_ref"), F.count_if(k == "hom_alt").alias("n_hom_alt"),
        F.count_if(k.isin("het_ref", "het_alt")).alias("n_het"), F.count_if(k == "mis").alias("n_missing"), F.count_if(nonref & snp).alias("n_snv"), F.count_if(nonref & ~snp).alias("n_indel"),
        F.count_if(nonref & snp & ts).alias("n_ts"), F.count_if(nonref & snp & ~ts).alias("n_tv"),
    )


def threshold_sweep(tidy: DataFrame, column: str, thresholds: list[int]) -> DataFrame:
    """sample_stats for rows with column above each threshold, in one pass: a row counts for every threshold it passes."""
    over = F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col(column) > t)
    return sample_stats(tidy.withColumn("threshold", F.explode(over)), "threshold")


def singletons(tidy: DataFrame) -> DataFrame:
    """Per sample: sites where it alone has the ALT allele, and has it once. Every sample has a row."""
    d = V.dosage(F.col("GT"))
    per = tidy.groupBy("site_id").agg(F.sum(d).alias("ac"), F.max_by("sample_id", d).alias("sample_id")).where("ac = 1")
    found = per.groupBy("sample_id").agg(F.count("*").alias("n"))
    return tidy.select("sample_id").distinct().join(found, "sample_id", "left").select("sample_id", F.coalesce("n", F.lit(0)).alias("n_singletons"))


SAMPLES = 2048  # samples of a block: the counts of two blocks' pairs are what a task holds


def concordance(tidy: DataFrame, width: int = SAMPLES) -> DataFrame:
    """For all pairs of samples a < b: sites where both are called, and where their genotypes have equal dosage.

    A site's dosages travel as one array for each block of `width` samples. Tasks count by products of 0/1 matrices, sites
    by samples, and send one row for each pair. Cohorts of several blocks meet block by block.
    """
    block = F.floor(F.col("sample_id") / width)
    rows = tidy.where(~V.in_class(F.col("GT"), "mis")).groupBy("site_id", block.alias("i")).agg(F.collect_list(F.struct((F.col("sample_id") % width).cast("int").alias("s"), V.dosage(F.col("GT")).cast("int").alias("d"))).alias("x"))
    sites = rows.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("blocks"))
    pairs = F.flatten(F.transform("blocks", lambda p: F.transform(F.filter("blocks", lambda q: q["i"] >= p["i"]), lambda q: F.struct(p["i"].alias("i"), q["i"].alias("j"), p["x"].alias("x"), q["x"].alias("y")))))

    def count(batches):
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in "ij"], 1)
            for i, j in np.unique(keys, axis=0).tolist():
                part = batch.filter(pa.array((keys == (i, j)).all(1)))
                for lo in range(0, part.num_rows, 512):
                    x, y = (_matrix(part.slice(lo, 512).column(c)) for c in "xy")
                    both = np.stack([(x >= 0).astype(np.float32).T @ (y >= 0).astype(np.float32), sum((x == d).astype(np.float32).T @ (y == d).astype(np.float32) for d in range(max(x.max(), y.max()) + 1))])
                    totals[i, j] = _added(totals.get((i, j)), both)
            while len(totals) > 4:
                yield _pair_rows(*totals.popitem(), width)
        for key, n in totals.items():
            yield _pair_rows(key, n, width)

    out = sites.select(F.inline(pairs)).mapInArrow(count, "a int, b int, n_sites long, n_same long")
    return out.groupBy("a", "b").agg(F.sum("n_sites").alias("n_sites"), F.sum("n_same").alias("n_same"))


def _matrix(col: pa.Array) -> np.ndarray:
    """Dosages, sites by samples of a block; -1 where a site has none."""
    items = col.flatten()
    row = np.repeat(np.arange(len(col)), col.value_lengths().to_numpy())
    s, d = items.field("s").to_numpy(), items.field("d").to_numpy()
    out = np.full((len(col), int(s.max()) + 1 if len(s) else 1), -1, np.int32)
    out[row, s] = d
    return out


def _added(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    if a is None:
        return b.astype(np.int64)
    out = np.zeros((2, max(a.shape[1], b.shape[1]), max(a.shape[2], b.shape[2])), np.int64)
    for x in (a, b):
        out[:, : x.shape[1], : x.shape[2]] += x.astype(np.int64)
    return out


def _pair_rows(key: tuple[int, int], n: np.ndarray, width: int) -> pa.RecordBatch:
    a, b = np.nonzero(n[0])
    keep = (key[0] < key[1]) | (a < b)
    a, b = a[keep], b[keep]
    return pa.record_batch([pa.array((a + key[0] * width).astype(np.int32)), pa.array((b + key[1] * width).astype(np.int32)), pa.array(n[0, a, b]), pa.array(n[1, a, b])], names=["a", "b", "n_sites", "n_same"])


def genotype_intersections(tidy: DataFrame) -> DataFrame:
    """samples, n: how many (site, genotype) groups have exactly these samples, in ascending order. Any number of samples."""
    groups = tidy.where(~V.in_class(F.col("GT"), "mis")).groupBy("site_id", "GT").agg(F.array_sort(F.collect_set("sample_id")).alias("samples"))
    return groups.groupBy("samples").agg(F.count("*").alias("n"))


def contrast(tidy: DataFrame, cases: Column, *keys: str) -> DataFrame:
    """Allele counts in cases and controls with Fisher's exact test, and whether the ALT is only in cases."""
    t = tidy.select(*keys, cases.alias("case"), F.inline(F.array(_counts()))).select(*keys, "case", F.col("AC").alias("ac"), F.col("AN").alias("an"))
    t = t.groupBy(*keys).agg(*(F.sum(F.when(F.col("case") == w, F.col(x)).otherwise(0)).alias(f"{x}_{n}") for n, w in (("case", True), ("ctrl", False)) for x in ("ac", "an")))
    tab = ["x1", "x2", "x3", "x4"]
    t = t.withColumns({"x1": F.col("an_ctrl") - F.col("ac_ctrl"), "x2": F.col("ac_ctrl"), "x3": F.col("an_case") - F.col("ac_case"), "x4": F.col("ac_case")})
    tested = t.select(*tab).distinct().withColumn("passoc", fisher_test(*tab))
    return t.join(tested, tab).withColumn("novel", (F.col("ac_case") > 0) & (F.col("ac_ctrl") == 0)).drop(*tab)


def polygenic_scores(tidy: DataFrame, weights: DataFrame, thresholds: list[float]) -> DataFrame:
    """Sum of dosage x beta per sample and p-value threshold. weights: site_id, beta, p."""
    rows = tidy.where(~V.in_class(F.col("GT"), "mis")).select("site_id", "sample_id", V.dosage(F.col("GT")).alias("d")).join(weights, "site_id")
    rows = rows.withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("p") <= t)))
    return rows.groupBy("sample_id", "threshold").agg(F.sum(F.col("d") * F.col("beta")).alias("score"), F.count("*").alias("n"))


def meta_analysis(studies: DataFrame, *keys: str) -> DataFrame:
    """Inverse-variance weighted effect, its standard error and Cochran's Q. studies: keys, beta, se."""
    w = 1 / (F.col("se") * F.col("se"))
    t = studies.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * F.col("beta")).alias("wb"), F.sum(w * F.col("beta") * F.col("beta")).alias("wbb"), F.count("*").alias("n"))
    return t.select(*keys, "n", (F.col("wb") / F.col("w")).alias("beta"), (1 / F.sqrt("w")).alias("se"), (F.col("wbb") - F.col("wb") * F.col("wb") / F.col("w")).alias("q"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Rows per bin of equal width; values outside go to the first and last bin."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((value - low) / (high - low) * bins).cast("int")))
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def meta_analysis_by_size(studies: DataFrame, *keys: str) -> DataFrame:
    """Effects combined as z scores weighted by the root of the sample size, and how far the studies differ: n, z, and i2, the
    share of Cochran's Q beyond its expectation. studies: keys, beta, se, size."""
    z, w = F.col("beta") / F.col("se"), 1 / (F.col("se") * F.col("se"))
    t = studies.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.sqrt("size") * z).alias("zs"), F.sum("size").alias("size"), F.sum(w).alias("w"), F.sum(w * F.col("beta")).alias("wb"), F.sum(w * F.col("beta") * F.col("beta")).alias("wbb"))
    q = F.col("wbb") - F.col("wb") * F.col("wb") / F.col("w")
    return t.select(*keys, "n", (F.col("zs") / F.sqrt("size")).alias("z"), F.when(q > 0, F.greatest(F.lit(0.0), (q - (F.col("n") - 1)) / q)).otherwise(0.0).alias("i2"))


def with_read_shares(nested: DataFrame) -> DataFrame:
    """Adds to every sample VAF, the share of each ALT in its reads, and VAF1, that of all ALTs; null without reads."""

    def shares(s: Column) -> Column:
        total = F.aggregate(s["AD"], F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
        return V.let(total, lambda n: F.struct(F.when(n > 0, F.transform(F.slice(s["AD"], F.lit(2), F.size("ALT")), lambda x: x / n)).alias("VAF"), F.when(n > 0, 1 - F.get(s["AD"], F.lit(0)) / n).alias("VAF1")))

    return nested.withColumn("samples", F.transform("samples", lambda s: V.let(shares(s), lambda x: s.withField("VAF", x["VAF"]).withField("VAF1", x["VAF1"]))))


def with_site_tags(sites: DataFrame) -> DataFrame:
    """Adds END, the last position of REF, and TYPE, the kinds of the ALTs. ALT is an array."""
    kinds = F.transform(V.types(F.col("REF"), F.col("ALT")), lambda t: F.when(t.isin("ins", "del"), "indel").otherwise(t))
    return sites.withColumns({"END": V.end_position(F.col("POS"), F.col("REF")), "TYPE": F.array_sort(F.array_distinct(kinds))})


def concordance_by_frequency(first: DataFrame, second: DataFrame, frequency: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """bin, gt1, gt2, n: how often genotypes of two sets meet, by the site's allele frequency. frequency: site_id, AF."""
    both = first.join(second.select(*keys, F.col("GT").alias("gt2")), keys).join(frequency, "site_id")
    b = F.least(F.lit(bins - 1), F.floor(F.col("AF") * bins).cast("int"))
    return both.groupBy(b.alias("bin"), F.col("GT").alias("gt1"), "gt2").agg(F.count("*").alias("n"))


def discordance_scores(nested: DataFrame, frequency: Column, likelihoods: str | None = None, error: float = 40.0, width: int = SAMPLES) -> DataFrame:
    """For all pairs of samples a < b: n_sites where both have data, n_match, score and hwe. Samples of a row are in one order.

    score adds up, over the sites, minus the logarithm of the probability that both samples' data come from one genotype: the sum
    over genotypes of the products of their likelihoods, which are those of the PL field named, or of genotypes of which all but the
    called one have the PL `error`. n_match counts sites of equal likeliest dosage (the lower of equals), and hwe adds up minus the
    logarithm of that dosage's Hardy-Weinberg probability under `frequency`, of the ALTs together: how little chance explains the match.
    Tasks count by products of matrices, sites by samples; cohorts of several blocks of `width` samples meet block by block.
    """
    low = float(10 ** (-error / 10))
    if likelihoods:
        of = lambda s: F.when((F.size(s[likelihoods]) == 3) & F.forall(s[likelihoods], lambda x: x.isNotNull()), F.transform(s[likelihoods], lambda x: F.pow(F.lit(10.0), -x.cast("double") / 10)))
    else:
        of = lambda s: F.when(~V.in_class(s["GT"], "mis"), F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.when(F.least(V.dosage(s["GT"]), F.lit(2)) == k, 1.0).otherwise(low)))
    none = F.array(*[F.lit(float("nan"))] * 3)
    every = F.transform("samples", lambda s: F.coalesce(of(s), none))
    f = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), frequency.cast("double")))
    rows = nested.select(every.alias("l"), F.array(-2 * F.log(1 - f), -F.log(2 * f * (1 - f)), -2 * F.log(f)).alias("w"))
    n_blocks = F.ceil(F.size("l") / width).cast("int")
    block = lambda i: F.slice("l", i * width + 1, F.lit(width))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.transform(F.sequence(i, n_blocks - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), block(i).alias("x"), block(j).alias("y")))))
    rows = rows.where("size(l) > 0").select("w", F.inline(pairs))

    def grid(col: pa.Array) -> np.ndarray:
        return col.flatten().flatten().to_numpy().reshape(len(col), -1, 3)

    def count(batches):
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in "ij"], 1)
            for i, j in np.unique(keys, axis=0).tolist():
                part = batch.filter(pa.array((keys == (i, j)).all(1)))
                for lo in range(0, part.num_rows, 256):
                    some = part.slice(lo, 256)
                    x, y, w = grid(some.column("x")), grid(some.column("y")), some.column("w").flatten().to_numpy().reshape(-1, 3)
                    has, have = ~np.isnan(x[..., 0]), ~np.isnan(y[..., 0])
                    x, y = np.nan_to_num(x), np.nan_to_num(y)
                    out = np.zeros((4, x.shape[1], y.shape[1]))
                    out[0] = has.astype(float).T @ have.astype(float)
                    for k in range(3):
                        a, b = (has & (x.argmax(2) == k)).astype(float), (have & (y.argmax(2) == k)).astype(float)
                        out[1] += a.T @ b
                        out[3] += (a * w[:, k : k + 1]).T @ b
                    for s in range(len(x)):  # a site's pairs at once
                        both = np.where(np.outer(has[s], have[s]), x[s] @ y[s].T, 1.0)
                        out[2] -= np.log(np.maximum(both, 1e-300))
                    totals[i, j] = out if (i, j) not in totals else totals[i, j] + out
            while len(totals) > 4:
                yield score_rows(*totals.popitem())
        for key, n in totals.items():
            yield score_rows(key, n)

    def score_rows(key: tuple[int, int], n: np.ndarray) -> pa.RecordBatch:
        a, b = np.meshgrid(np.arange(n.shape[1]) + key[0] * width, np.arange(n.shape[2]) + key[1] * width, indexing="ij")
        use = a < b
        return pa.record_batch([pa.array(a[use], pa.int32()), pa.array(b[use], pa.int32()), pa.array(n[0][use].astype(np.int64)), pa.array(n[1][use].astype(np.int64)), pa.array(n[2][use]), pa.array(n[3][use])], names=["a", "b", "n_sites", "n_match", "score", "hwe"])

    out = rows.mapInArrow(count, "a int, b int, n_sites long, n_match long, score double, hwe double")
    return out.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n_sites", "n_match", "score", "hwe")))
