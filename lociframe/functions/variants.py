"""Column functions on alleles and genotypes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC ambiguity codes by the sorted pair of bases.
IUPAC = {"AA": "A", "CC": "C", "GG": "G", "TT": "T", "AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once and appears once in the plan, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def base_at(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1))


def base_from_end(s: Column, i: Column) -> Column:
    return F.substring(s, F.length(s) - i + 1, F.lit(1))


def common(a: Column, b: Column, most: Column, at: Callable[[Column, Column], Column]) -> Column:
    """How many bases in a row agree, the first `most` at most, by at (base_at or base_from_end)."""
    return F.when(most < 1, 0).otherwise(F.aggregate(F.sequence(F.lit(1), most), F.lit(0), lambda n, i: F.when((n == i - 1) & (at(a, i) == at(b, i)), i).otherwise(n)))


def allele_type(ref: Column, alt: Column) -> Column:
    """Type of one ALT allele: ref, snp, mnp, ins, del, bnd, overlap or other.

    Alleles of one base are told apart by plain comparisons; only longer ones have their common ends looked for.
    """
    n, m = F.length(ref), F.length(alt)

    def differing(r: Column, a: Column, rn: Column, an: Column) -> Column:
        def rest(suffix: Column) -> Column:
            rl, al = rn - suffix, an - suffix
            last = base_at(r, rl) == base_at(a, al)
            return F.when((rl == 1) & (al == 1), "snp").when((rl == 1) & last, "ins").when((al == 1) & last, "del").when(rl == al, "mnp").otherwise("other")

        return F.when((rn == 0) & (an == 0), "ref").when(rn == 0, "ins").when(an == 0, "del").otherwise(let(common(r, a, F.least(rn, an) - 1, base_from_end), rest))

    def after(prefix: Column) -> Column:
        ends = F.struct(F.substring(ref, prefix + 1, n).alias("r"), F.substring(alt, prefix + 1, m).alias("a"), (n - prefix).alias("rn"), (m - prefix).alias("an"))
        return let(ends, lambda x: differing(x["r"], x["a"], x["rn"], x["an"]))

    return (
        F.when((n == 1) & (m == 1), F.when(alt == "*", "overlap").when(alt.isin(".", "X") | (F.upper(ref) == F.upper(alt)), "ref").otherwise("snp"))
        .when(alt.isin("<*>", "<X>", "<NON_REF>"), "ref").when(alt.startswith("<"), "other").when(alt == "*", "overlap").when(alt.rlike(r"[\[\]]"), "bnd")
        .otherwise(let(common(ref, alt, F.least(n, m), base_at), after))
    )


def types(ref: Column, alts: Column) -> Column:
    """Types of all ALT alleles."""
    return F.transform(alts, lambda a: allele_type(ref, a))


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(F.upper(ref), F.upper(alt)).isin("AG", "GA", "CT", "TC")


def indel_length(ref: Column, alt: Column) -> Column:
    """len(ALT) - len(REF); null for symbolic alleles."""
    return F.when(~alt.rlike(r"[<\[\]*]"), F.length(alt) - F.length(ref))


def end_position(pos: Column, ref: Column) -> Column:
    return pos + F.length(ref) - 1


def alleles(gt: Column) -> Column:
    """Allele numbers of a genotype text; null for a missing one."""
    return F.transform(F.split(gt, "[/|]"), lambda a: F.when(a != ".", a.try_cast("int")))


def is_phased(gt: Column) -> Column:
    return gt.contains("|") & ~gt.contains("/")


def genotype_class(gt: Column) -> Column:
    """mis, hap_ref, hap_alt, hom_ref, hom_alt, het_ref (one REF) or het_alt (two different ALTs)."""

    def general(a: Column) -> Column:
        zero = F.array_contains(a, 0)
        same = F.size(F.array_distinct(a)) == 1
        return F.when(F.exists(a, lambda x: x.isNull()), "mis").when(F.size(a) == 1, F.when(zero, "hap_ref").otherwise("hap_alt")).when(same, F.when(zero, "hom_ref").otherwise("hom_alt")).otherwise(F.when(zero, "het_ref").otherwise("het_alt"))

    # the usual texts are compared as they are; only others are taken apart
    return (
        F.when(gt.isin("0/0", "0|0"), "hom_ref").when(gt.isin("0/1", "0|1", "1|0", "1/0"), "het_ref").when(gt.isin("1/1", "1|1"), "hom_alt")
        .when(gt.isNull() | gt.isin("./.", ".|.", "."), "mis").otherwise(let(alleles(gt), general))
    )


def dosage(gt: Column) -> Column:
    """ALT alleles of a genotype; missing ones count as none."""
    usual = F.when(gt.isin("0/0", "0|0", "./."), 0).when(gt.isin("0/1", "0|1", "1|0", "1/0"), 1).when(gt.isin("1/1", "1|1"), 2)
    return usual.otherwise(F.size(F.filter(alleles(gt), lambda x: x > 0)))


def in_class(gt: Column, name: str) -> Column:
    """GT="name" of the expression language."""
    k = genotype_class(gt)
    members = {
        "mis": ["mis"], "hom": ["hom_ref", "hom_alt"], "het": ["het_ref", "het_alt"], "hap": ["hap_ref", "hap_alt"], "ref": ["hom_ref", "hap_ref"],
        "alt": ["het_ref", "het_alt", "hom_alt", "hap_alt"], "rr": ["hom_ref"], "ra": ["het_ref"], "aa": ["hom_alt"], "aA": ["het_alt"], "r": ["hap_ref"], "a": ["hap_alt"],
    }[name]
    return k.isin(*members)


def translated(gt: Column, ref: Column, alts: Column) -> Column:
    """Genotype with bases for allele numbers, separators kept."""
    all_ = F.concat(F.array(ref), alts)
    base = lambda x: F.when(x.isNull(), ".").otherwise(F.try_element_at(all_, x + 1))
    joined = F.transform(alleles(gt), base)
    return F.when(is_phased(gt), F.array_join(joined, "|")).otherwise(F.array_join(joined, "/"))


def once(x: Column, f) -> Column:
    """f(x) with x evaluated once a row, however often f uses it; f may be used within other lambdas."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def iupac(gt: Column, ref: Column, alts: Column) -> Column:
    """One-letter code of a genotype of single bases; . if any allele is missing, N for other alleles."""
    all_ = F.concat(F.array(ref), alts)
    pair = lambda a: F.array_join(F.array_sort(F.transform(a, lambda x: F.upper(F.try_element_at(all_, x + 1)))), "")
    code = lambda p: reduce(lambda c, kv: c.when(p == kv[0], kv[1]), list(IUPAC.items())[1:], F.when(p == next(iter(IUPAC)), next(iter(IUPAC.values())))).otherwise("N")
    return once(alleles(gt), lambda a: F.when(F.exists(a, lambda x: x.isNull()), ".").otherwise(once(pair(a), code)))


def binomial_test(a: Column, b: Column) -> Column:
    """Two-sided exact test of a against b with p = 1/2: null if both are 0, else min(1, 2 P(X >= max))."""

    def test(v: Column) -> Column:
        n, top = v["n"], v["top"]
        # log C(n, top), then the upper tail by the ratios of its terms
        log = F.when(n == top, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), (n - top).cast("int")), F.lit(0.0), lambda s, i: s + F.log((top + i) / i)))
        one = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
        step = lambda r: lambda x, k: once(x["t"] * r(k), lambda t: F.struct(t.alias("t"), (x["s"] + t).alias("s")))
        ratios = F.aggregate(F.sequence(top.cast("int"), (n - 1).cast("int")), one, step(lambda k: (n - k) / (k + 1)), lambda x: x["s"])
        tail = F.exp(log - n * F.log(F.lit(2.0))) * F.when(n == top, 1.0).otherwise(ratios)
        return F.when(n > 0, F.when(n == 2 * top, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail)))

    return once(F.struct((a + b).cast("double").alias("n"), F.greatest(a, b).cast("double").alias("top")), test)


def variant_key_position(chrom: Column, pos: Column) -> Column:
    """64-bit key of contig number and 0-based position, for range-sorted storage."""
    number = F.regexp_extract(chrom, r"(\d+)$", 1).try_cast("long")
    return F.shiftleft(number, 28).bitwiseOR(pos - 1)


SHORT_ALLELES = 11  # bases of REF and ALT together that a key holds as they are


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """64-bit key of a biallelic variant: 5 bits of the contig (1 to 22, X 23, Y 24, M or MT 25, else 0), 28 of the 0-based
    position, and 31 of the alleles: lengths of 4 bits each and two bits a base where REF and ALT have 11 bases of ACGT at most
    (the last bit is 0), else a hash (the last bit is 1). Keys sort by contig and position."""
    name = F.upper(F.regexp_replace(chrom, "(?i)^chr", ""))
    number = F.when(name == "X", 23).when(name == "Y", 24).when(name.isin("M", "MT"), 25).when(name.rlike("^([1-9]|1[0-9]|2[0-2])$"), name.try_cast("int")).otherwise(0)
    n, m = F.length(ref), F.length(F.coalesce(alt, F.lit("")))
    both = F.upper(F.concat(ref, F.coalesce(alt, F.lit(""))))
    digits = F.rpad(F.translate(both, "ACGT", "0123"), SHORT_ALLELES, "0")
    packed = F.shiftleft(n.cast("long"), 27).bitwiseOR(F.shiftleft(m.cast("long"), 23)).bitwiseOR(F.shiftleft(F.conv(digits, 4, 10).cast("long"), 1))
    hashed = F.xxhash64(F.upper(ref), F.upper(F.coalesce(alt, F.lit("")))).bitwiseAND(F.lit((1 << 31) - 1)).bitwiseOR(F.lit(1))
    short = (n + m <= SHORT_ALLELES) & both.rlike("^[ACGT]+$")
    return F.shiftleft(number.cast("long"), 59).bitwiseOR(F.shiftleft((pos - 1).cast("long"), 31)).bitwiseOR(F.when(short, packed).otherwise(hashed))


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-tailed exact test of [[a, b], [c, d]]: the probability of all tables with its margins that are no likelier.

    Tables are weighed against the table given: their weights follow from one another by the ratio of neighbours, upwards and
    downwards from it, so that one pass adds up all of them and those no heavier than it."""

    def test(t: Column) -> Column:
        r1, c1, rest, own = t["r1"], t["c1"], t["rest"], t["a"]
        low, high = F.greatest(F.lit(0.0), -rest), F.least(r1, c1)
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("part"), F.lit(0.0).alias("all"))
        counted = lambda s: (s["part"] + F.when(s["w"] <= 1 + 1e-7, s["w"]).otherwise(0.0), s["all"] + s["w"])

        def add(ratio: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
            """A step counts the weight of the step before, so that every weight is worked out in one place."""
            return lambda s, x: F.struct((s["w"] * ratio(x)).alias("w"), counted(s)[0].alias("part"), counted(s)[1].alias("all"))

        last_too = lambda s: F.struct(counted(s)[0].alias("part"), counted(s)[1].alias("all"))
        cells = lambda some, first, last, step: F.when(some, F.sequence(first.cast("int"), last.cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))
        up = F.aggregate(cells(own < high, own + 1, high, 1), start, add(lambda x: (r1 - x + 1) * (c1 - x + 1) / (x * (rest + x))), last_too)
        down = F.aggregate(cells(own > low, own - 1, low, -1), start, add(lambda x: (x + 1) * (rest + x + 1) / ((r1 - x) * (c1 - x))), last_too)
        return let(F.struct(up.alias("u"), down.alias("d")), lambda s: F.least(F.lit(1.0), (s["u"]["part"] + s["d"]["part"] - 1) / (s["u"]["all"] + s["d"]["all"] - 1)))  # the table itself is in both

    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    cells = F.struct(a.alias("a"), (a + b).alias("r1"), (a + c).alias("c1"), (d - a).alias("rest"))  # margins, and how many more d is than a
    return F.when(a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull(), let(cells, test))
