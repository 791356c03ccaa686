"""Sections of statistics: against counting record by record, and parts merged against the whole."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lociframe.operators import statistics as T

REFS = [("A", ["G"]), ("A", ["C"]), ("A", ["ACC"]), ("A", ["ACCT"]), ("ACC", ["A"]), ("ACCT", ["A"]), ("A", ["G", "C"]), ("A", ["G", "ATTT"]), ("AC", ["A", "ACTT"]), ("A", []), ("AC", ["GT"]), ("N", ["A"])]
GTS = ["0/0", "0/1", "1/1", "./.", "0|1", "1", "0", "./1", ".", None]
TWO = [*GTS, "0/2", "1/2", "2/2", "2|1"]
KIND = {("A", "G"): "snp", ("A", "C"): "snp", ("A", "ACC"): "ins", ("A", "ACCT"): "ins", ("ACC", "A"): "del", ("ACCT", "A"): "del", ("A", "ATTT"): "ins", ("AC", "A"): "del", ("AC", "ACTT"): "ins", ("AC", "GT"): "mnp", ("N", "A"): "snp"}
EXONS = [("1", 1, 20), ("1", 15, 40), ("2", 30, 33)]
SCHEMA = "site_id int, CHROM string, POS int, REF string, ALT array<string>, QUAL double, tag double, AF double, samples array<struct<sample_id:int,GT:string,DP:int>>"


def records(seed, n=150, samples=3, change=0.0, back=False):
    rng, other, out = random.Random(seed), random.Random(seed + 1), []
    for i in range(n):
        ref, alts = rng.choice(REFS)
        gts = [rng.choice(TWO if len(alts) > 1 else GTS if alts else ["0/0", "./."]) for _ in range(samples)]
        depth = [rng.choice([None, 0, 3, 9]) for _ in range(samples)]
        row = [i, rng.choice("12"), rng.randint(1, 45), ref, alts, rng.choice([None, 0.0, 9.96, 30.5, -1.0]), rng.choice([None, -1.0, 0.0, 0.31, 0.5, 0.99, 2.0]), rng.choice([None, 0.0, 0.2, 0.77, 1.0])]
        if change:
            gts = [other.choice(TWO if len(alts) > 1 else GTS) if other.random() < change else g for g in gts]
        s = list(zip(range(samples), gts, depth, strict=True))
        out.append((*row, s[::-1] if back else s))
    return out


def table(df):
    return {(r.section, r.key, r.bin, r.counter): r.n for r in df.collect() if r.n}


def change(ref, alt):
    return None if {ref, alt} - set("ACGT") else "ts" if {ref, alt} in ({"A", "G"}, {"C", "T"}) else "tv"


def frame(chrom, pos, ref, alt):
    if KIND[ref, alt] not in ("ins", "del"):
        return "na"
    inside = next((e for c, b, e in sorted(EXONS) if c == chrom and b <= pos <= e), None)
    if inside is None:
        return "na"
    n = len([p for p in range(pos + 1, pos + len(ref)) if p <= inside]) if len(ref) > len(alt) else (len(alt) - len(ref) if pos < inside else 0)
    return "na" if n == 0 else "out" if n % 3 else "in"


def of_sites(rows):
    c = Counter()
    for _, chrom, pos, ref, alts, qual, tag, _, _ in rows:
        kinds = [KIND[ref, a] for a in alts]
        c["SN", "", 0, "records"] += 1
        c["SN", "", 0, "no_alts"] += not alts
        for name, of in (("snps", {"snp"}), ("mnps", {"mnp"}), ("indels", {"ins", "del"})):
            c["SN", "", 0, name] += bool(of & set(kinds))
        c["SN", "", 0, "multiallelic"] += len(alts) > 1
        c["SN", "", 0, "multiallelic_snps"] += len(alts) > 1 and set(kinds) == {"snp"}
        q = 0 if qual is None or qual < 0 else 1 + int(qual * 10)
        c["QUAL", "", q, "snps"] += "snp" in kinds
        c["QUAL", "", q, "indels"] += bool({"ins", "del"} & set(kinds))
        for i, (a, k) in enumerate(zip(alts, kinds, strict=True)):
            if k in ("ins", "del"):
                c["IDD", "", len(a) - len(ref), "alleles"] += 1
                for name in [frame(chrom, pos, ref, a), *[frame(chrom, pos, ref, a) + "_first"][i:1]]:
                    c["FS", "", 0, name] += 1
            if k == "snp" and (x := change(ref, a)):
                c["TSTV", "", 0, x] += 1
                c["TSTV", "", 0, x + "_first"] += i == 0
                c["ST", f"{ref}>{a}", 0, "alleles"] += 1
                if tag is not None:
                    c["USR", "tag", 0 if tag <= 0 else 9 if tag >= 1 else int(tag * 9), x] += 1
    return {k: n for k, n in c.items() if n}


def split(gt):
    return [None if a == "." else int(a) for a in (gt or ".").replace("|", "/").split("/")]


def of_samples(rows):
    c = Counter()
    for _, chrom, pos, ref, alts, *_, samples in rows:
        diploid = [i for i, gt, _ in samples if len(split(gt)) == 2 and None not in split(gt) and any(split(gt))]
        for i, gt, dp in samples:
            a = split(gt)
            psc, psi = (lambda name, n=1, i=i: c.update({("PSC", str(i), 0, name): n})), (lambda name, n=1, i=i: c.update({("PSI", str(i), 0, name): n}))
            if dp:
                psc("depth", dp)
                psc("n_depth")
            if None in a:
                psc("missing")
                continue
            kinds = [KIND[ref, alts[x - 1]] if x else "ref" for x in a]
            indel = {"ins", "del"} & set(kinds)
            for x in a if indel else []:
                psi(frame(chrom, pos, ref, alts[x - 1]) if x else "na")
            if len(a) == 1:
                psc("hap_alt" if a[0] else "hap_ref")
                continue
            if not any(a):
                psc("ref_hom")
                continue
            psc("singletons", diploid == [i])
            psc("indels", bool(indel))
            hom = a[0] == a[1]
            psc("nonref_hom" if hom else "hets", "snp" in kinds)
            for x in {x for x in a if x}:
                if KIND[ref, alts[x - 1]] == "snp" and (name := change(ref, alts[x - 1])):
                    psc(name)
            for kind in indel:
                psi(f"{kind}_{'homs' if hom else 'hets'}")
    return {k: n for k, n in c.items() if n}


@pytest.fixture(scope="module")
def exons(spark):
    return spark.createDataFrame(EXONS, "c2 string, b2 int, e2 int")


def every(df, exons):
    tags = [("tag", F.col("tag"), 0.0, 1.0, 10)]
    return T.merged(T.site_sections(df, tags), T.frame_section(df, exons), T.sample_section(df, "DP"), T.sample_indel_section(df, exons))


def test_sections_and_merging(spark, exons):
    rows = records(3)
    whole = table(every(spark.createDataFrame(rows, SCHEMA), exons))
    assert whole == of_sites(rows) | of_samples(rows)
    parts = [every(spark.createDataFrame(rows[i:j], SCHEMA), exons) for i, j in ((0, 1), (1, 90), (90, 150))]
    assert table(T.merged(*parts)) == whole == table(T.merged(T.merged(parts[2], parts[0]), parts[1]))


def test_reading(spark, exons):
    rows = records(5)
    t = every(spark.createDataFrame(rows, SCHEMA), exons)
    want = of_sites(rows) | of_samples(rows)
    got = {r.sample: r for r in T.sample_indels(t).collect()}
    assert {(k, name): got[k][name] for k in got for name in ("in", "out", "na", "ins_hets", "del_homs")} == {(k, name): want.get(("PSI", k, 0, name), 0) for k in "012" for name in ("in", "out", "na", "ins_hets", "del_homs")}
    assert all(r.out_share == r.out / (r["in"] + r.out) for r in got.values())
    for r in T.sample_counts(t).collect():
        assert r.mean_depth == want["PSC", r.sample, 0, "depth"] / want["PSC", r.sample, 0, "n_depth"]
    assert {round(r.value, 6): r.snps for r in T.user_histogram(t, "tag", 0.0, 1.0, 10).collect()} == {round(b / 9, 6): sum(want.get(("USR", "tag", b, x), 0) for x in ("ts", "tv")) for b in range(10) if any(k[:3] == ("USR", "tag", b) for k in want)}
    f = T.frames(t).first()
    assert (f["in"], f.out, f.na_first) == tuple(want.get(("FS", "", 0, x), 0) for x in ("in", "out", "na_first"))


@pytest.mark.parametrize("back", [False, True])
def test_two_sets(spark, back):
    first, second = records(7), records(7, change=0.4, back=back)
    keys = ["site_id"]
    cut = lambda a, b: T.pair_sections(spark.createDataFrame(first[a:b], SCHEMA), spark.createDataFrame(second[20:], SCHEMA), F.col("AF"), keys, 10)
    t = T.merged(cut(0, 60), cut(60, 150))
    assert table(t) == table(cut(0, 150))
    name = {(0, 0): "rr", (0,): "r"}

    def cls(gt):
        a = split(gt)
        if None in a:
            return "x"
        return name.get(tuple(a)) or ("a" if len(a) == 1 else "aa" if a[0] == a[1] else "ra" if 0 in a else "ab")

    dose, stat = {"rr": 0, "ra": 1, "aa": 2, "ab": 2, "r": 0, "a": 1}, {"r": "rr", "a": "aa"}
    pairs = []
    for x, y in zip(first[20:], second[20:], strict=True):
        other = {s[0]: s[1] for s in y[-1]}
        kind = "snps" if any(KIND[x[3], a] == "snp" for a in x[4]) else "indels"
        pairs += [(kind, str(i), min(9, int((x[7] or 0) * 10)), cls(gt), cls(other[i])) for i, gt, _ in x[-1]]
    for by, place, known in (("sample", 1, {"rr", "ra", "aa"}), ("frequency", 2, {"rr", "ra", "aa", "ab"})):
        got = T.concordance(t, by).collect()
        groups = {(p[0], p[place]) for p in pairs}
        assert {(r.kind, r[1]) for r in got} == groups
        for r in got:
            own = [p[3:] for p in pairs if (p[0], p[place]) == (r.kind, r[1])]
            plain = [(stat.get(a, a), stat.get(b, b)) for a, b in own]
            plain = [p for p in plain if set(p) <= known]
            bad, good = sum(a != b for a, b in plain), sum(a == b != "rr" for a, b in plain)
            assert r.nrd == pytest.approx(100 * bad / (bad + good) if bad + good else 0)
            assert [r.rr_match, r.ra_match, r.aa_match] == [sum(a == b == c for a, b in plain) for c in ("rr", "ra", "aa")]
            assert [r.rr_mismatch, r.ra_mismatch, r.aa_mismatch] == [sum(a == c != b for a, b in plain) for c in ("rr", "ra", "aa")]
            d = [(dose[a], dose[b]) for a, b in own if "x" not in (a, b) and (len(a) == 1) == (len(b) == 1)]
            assert r.n == len(d)
            m1, m2 = (sum(x) / len(d) for x in zip(*d, strict=True)) if d else (0, 0)
            v1, v2, v12 = sum((a - m1) ** 2 for a, _ in d), sum((b - m2) ** 2 for _, b in d), sum((a - m1) * (b - m2) for a, b in d)
            assert r.r2 == (pytest.approx(v12 * v12 / (v1 * v2)) if v1 * v2 > 1e-12 else None)


def test_empty(spark, exons):
    none = spark.createDataFrame([], SCHEMA)
    t = T.merged(every(none, exons), T.pair_sections(none, none, F.col("AF")))
    assert t.collect() == [] and T.sample_indels(t).collect() == [] and T.concordance(t).collect() == []
