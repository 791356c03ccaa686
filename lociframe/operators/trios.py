"""Operators over families."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions import variants as V
from lociframe.operators.joins import overlap_join


def with_trios(nested: DataFrame, trios: list[tuple[int, int, int]]) -> DataFrame:
    """A row per site and trio (child, father, mother) with their genotypes. The pedigree is a short list of the caller's;
    genotypes are read from the site's own array, so nothing is shuffled."""
    gt = lambda i: F.get(F.filter("samples", lambda s: s["sample_id"] == i), F.lit(0))["GT"]
    rows = F.array(*(F.struct(F.lit(c).alias("child"), F.lit(f).alias("father"), F.lit(m).alias("mother"), gt(c).alias("gt_child"), gt(f).alias("gt_father"), gt(m).alias("gt_mother")) for c, f, m in trios))
    return nested.select(*[c for c in nested.columns if c != "samples"], F.inline(rows))


def mendelian(child: Column, father: Column, mother: Column) -> Column:
    """good, missing, error, or missing_error, which counts for both."""
    k, f, m = (V.alleles(g) for g in (child, father, mother))
    no_f, no_m = F.exists(f, lambda x: x.isNull()), F.exists(m, lambda x: x.isNull())
    has = lambda who, x: F.exists(who, lambda y: y == x)
    good = (has(f, k[0]) & has(m, k[1])) | (has(m, k[0]) & has(f, k[1]))
    shares = lambda who: F.coalesce(has(who, k[0]) | has(who, k[1]), F.lit(False))
    one_missing = F.when(no_f, shares(m)).otherwise(shares(f))
    return (
        F.when(V.in_class(child, "mis"), "missing").when(F.coalesce(good, F.lit(False)), "good").when(no_f & no_m, "missing")
        .when(no_f | no_m, F.when(one_missing, "missing").otherwise("missing_error")).otherwise("error")
    )


def mendelian_counts(nested: DataFrame, trios: list[tuple[int, int, int]]) -> DataFrame:
    rows = with_trios(nested, trios).withColumn("k", mendelian(F.col("gt_child"), F.col("gt_father"), F.col("gt_mother")))
    return rows.groupBy("child").agg(F.count_if(F.col("k") == "good").alias("n_good"), F.count_if(F.col("k").startswith("missing")).alias("n_missing"), F.count_if(F.col("k").endswith("error")).alias("n_error"))


def transmission(nested: DataFrame, trios: list[tuple[int, int, int]]) -> DataFrame:
    """For heterozygous parents against homozygous reference partners: how often the ALT reached the child."""
    rows = with_trios(nested, trios).where(~V.in_class(F.col("gt_child"), "mis"))
    het, ref = lambda g: V.in_class(F.col(g), "het"), lambda g: V.in_class(F.col(g), "rr")
    informative = (het("gt_father") & ref("gt_mother")) | (ref("gt_father") & het("gt_mother"))
    return rows.where(informative).groupBy("child").agg(F.count("*").alias("n"), F.count_if(V.in_class(F.col("gt_child"), "alt")).alias("n_transmitted"))


def de_novo(nested: DataFrame, trios: list[tuple[int, int, int]]) -> DataFrame:
    """Sites and trios where the child has an allele that neither parent has; all three are called."""
    rows = with_trios(nested, trios)
    k, f, m = (V.alleles(F.col(c)) for c in ("gt_child", "gt_father", "gt_mother"))
    known = lambda a: F.forall(a, lambda x: x.isNotNull())
    new = F.array_except(k, F.concat(f, m))
    return rows.where(known(k) & known(f) & known(m)).withColumn("new", new).where(F.size("new") > 0)


# --- likelihoods ------------------------------------------------------------------------------------------------------


@cache
def inheritance(n: int, mutation: float) -> tuple[np.ndarray, np.ndarray]:
    """P(child | father, mother) over unphased genotypes of n alleles in the order of PL, [father, mother, child]: without any new
    mutation, and with one at least. A transmitted allele mutates with the probability given, to any other allele alike."""
    pairs = [(a, b) for b in range(n) for a in range(b + 1)]
    passed = np.zeros((len(pairs), n))
    for g, (a, b) in enumerate(pairs):
        passed[g, a] += 0.5
        passed[g, b] += 0.5
    change = np.full((n, n), mutation / max(1, n - 1))
    np.fill_diagonal(change, 0.0)
    same, new = passed * (1 - mutation), passed @ change

    def both(f: np.ndarray, m: np.ndarray) -> np.ndarray:
        cross = f[:, None, :, None] * m[None, :, None, :]
        return np.stack([cross[:, :, a, b] + (cross[:, :, b, a] if a != b else 0.0) for a, b in pairs], -1)

    return both(same, same), both(same, new) + both(new, same) + both(new, new)


def de_novo_scores(nested: DataFrame, trios: list[tuple[int, int, int]], likelihoods: str = "PL", mutation: float = 1e-8, frequencies: str | None = None) -> DataFrame:
    """A row per site and trio whose three members have PL: the site's columns without samples, child, father, mother, p_dnm, the
    probability that the child has a new mutation, log_odds (base 10) of one against none, and dnm_alleles, the child's genotype that the
    mutation makes likeliest.

    Genotypes of the parents are weighed alike, or by Hardy-Weinberg proportions of `frequencies`, an array column of the
    ALTs' frequencies. All triples of genotypes are summed, for all sites of a batch at once; the pedigree is a short list.
    """
    pick = lambda i: F.get(F.filter("samples", lambda s: s["sample_id"] == i), F.lit(0))[likelihoods]
    rows = F.array(*(F.struct(F.lit(c).alias("child"), F.lit(f).alias("father"), F.lit(m).alias("mother"), *(pick(x).cast("array<double>").alias(n) for x, n in ((c, "_c"), (f, "_f"), (m, "_m")))) for c, f, m in trios))
    plain = [c for c in nested.columns if c != "samples"]
    t = nested.select(*plain, (F.col(frequencies).cast("array<double>") if frequencies else F.lit(None).cast("array<double>")).alias("_q"), F.inline(rows))
    n = F.size("ALT") + 1
    t = t.where((F.size("_c") == n * (n + 1) / 2) & (F.size("_f") == F.size("_c")) & (F.size("_m") == F.size("_c")) & (F.size("ALT") > 0))
    t = t.where(F.forall(F.concat("_c", "_f", "_m"), lambda x: x.isNotNull()))
    names = [c for c in t.columns if c not in ("_c", "_f", "_m", "_q")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in t.select(*names).schema)

    def score(batches):
        for batch in batches:
            size = batch.column("_c").value_lengths().to_numpy(zero_copy_only=False)
            p, odds, best = np.zeros(batch.num_rows), np.zeros(batch.num_rows), [""] * batch.num_rows
            for g in np.unique(size).tolist():
                at = np.flatnonzero(size == g)
                k = int((np.sqrt(8 * g + 1) - 1) / 2)
                pairs = [(a, b) for b in range(k) for a in range(b + 1)]
                c, f, m = (10 ** (-batch.column(x).take(pa.array(at)).flatten().to_numpy().reshape(-1, g) / 10) for x in ("_c", "_f", "_m"))
                if frequencies:
                    alt = np.array(batch.column("_q").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, k - 1)
                    q = np.concatenate([1 - alt.sum(1, keepdims=True), alt], 1)
                    weight = np.stack([q[:, a] * q[:, b] * (1 if a == b else 2) for a, b in pairs], 1)
                    f, m = f * weight, m * weight
                none, some = inheritance(k, mutation)
                without = np.einsum("ni,nj,nk,ijk->n", f, m, c, none, optimize=True)
                by_child = np.einsum("ni,nj,nk,ijk->nk", f, m, c, some, optimize=True)
                mutated = by_child.sum(1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    p[at], odds[at] = mutated / (mutated + without), np.log10(mutated) - np.log10(without)
                for i, x in zip(at.tolist(), by_child.argmax(1).tolist(), strict=True):
                    best[i] = f"{pairs[x][0]}/{pairs[x][1]}"
            yield pa.record_batch([*(batch.column(x) for x in names), pa.array(p), pa.array(odds), pa.array(best, pa.string())], names=[*names, "p_dnm", "log_odds", "dnm_alleles"])

    return t.mapInArrow(score, f"{kinds}, p_dnm double, log_odds double, dnm_alleles string")


def parental_origin(nested: DataFrame, regions: DataFrame, trios: list[tuple[int, int, int]], kind: str, error: float = 1e-2, bin_size: int = 1024) -> DataFrame:
    """Which parent a child's deletion or duplication came from: region, child, father, mother, n_markers, log_ratio, origin, quality.

    regions: region (an id), c, b, e (1-based, closed). "del": a homozygous child shows the one allele it has, which the parent
    without the deletion gave. "dup": at sites where the parents are homozygous for different alleles, two thirds of the child's reads
    (AD) are of the parent that gave two copies. log_ratio (natural) of paternal against maternal is a sum over the region's sites of
    one ALT; quality is 10 |log10|. Only sums leave a task.
    """
    if kind not in ("del", "dup"):
        raise ValueError(f"no such kind: {kind}")
    member = lambda i: F.get(F.filter("samples", lambda s: s["sample_id"] == i), F.lit(0))
    reads = "AD" in nested.schema["samples"].dataType.elementType.names
    rows = F.array(*(F.struct(F.lit(c).alias("child"), F.lit(f).alias("father"), F.lit(m).alias("mother"), member(c)["GT"].alias("_c"), member(f)["GT"].alias("_f"), member(m)["GT"].alias("_m"), (member(c)["AD"].cast("array<double>") if reads else F.lit(None).cast("array<double>")).alias("_ad")) for c, f, m in trios))
    t = nested.where(F.size("ALT") == 1).select(F.col("CHROM").alias("c"), F.col("POS").alias("b"), F.col("POS").alias("e"), F.inline(rows))
    share = lambda g: F.when(~V.in_class(F.col(g), "mis") & (F.size(V.alleles(F.col(g))) == 2), V.dosage(F.col(g)) / 2)
    t = t.withColumns({"_f": share("_f"), "_m": share("_m"), "_c": share("_c")}).where("_f is not null and _m is not null and _f <> _m")
    seen = lambda p, x: (1 - error) * F.when(x == 1, p).otherwise(1 - p) + error * F.when(x == 1, 1 - p).otherwise(p)
    if kind == "del":
        t = t.where("_c in (0, 1)").withColumn("_l", F.log(seen(F.col("_m"), F.col("_c"))) - F.log(seen(F.col("_f"), F.col("_c"))))
    else:
        t = t.where("abs(_f - _m) = 1 and size(_ad) = 2")
        ref, alt = F.coalesce(F.get("_ad", F.lit(0)), F.lit(0.0)), F.coalesce(F.get("_ad", F.lit(1)), F.lit(0.0))
        # two thirds against one third of the reads have the father's allele
        t = t.withColumn("_l", F.when(F.col("_f") == 1, alt - ref).otherwise(ref - alt) * F.log(F.lit(2.0)))
    # sites of one position are added up before they meet the regions
    t = t.groupBy("c", "b", "e", "child", "father", "mother").agg(F.count("*").alias("_n"), F.sum("_l").alias("_l"))
    both = overlap_join(t, regions.select("region", F.col("c").alias("c2"), F.col("b").alias("b2"), F.col("e").alias("e2")), bin_size)
    out = both.groupBy("region", "child", "father", "mother").agg(F.sum("_n").alias("n_markers"), F.sum("_l").alias("log_ratio"))
    origin = F.when(F.col("log_ratio") > 0, "paternal").when(F.col("log_ratio") < 0, "maternal")
    return out.withColumns({"origin": origin, "quality": F.abs("log_ratio") * 10 / F.log(F.lit(10.0))})
