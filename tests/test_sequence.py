"""Operators on a reference in blocks against sequential versions, with repeats that span several blocks."""

import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import sequence as Q

rng = random.Random(11)
CONTIGS = {"a": "".join(rng.choice("ACGT") for _ in range(40)) + "A" * 75 + "CG" * 40 + "TTTACG" * 12 + "".join(rng.choice("ACGTn") for _ in range(30)), "b": "GAGA" * 20, "c": "T"}
WIDTH = 16


@pytest.fixture(scope="module")
def reference(spark):
    pieces, at = [], 0
    for name, s in CONTIGS.items():
        at = 0
        while at < len(s):
            n = rng.randint(1, 25)
            pieces.append((name, at, s[at : at + n]))
            at += n
    rng.shuffle(pieces)
    return Q.in_pieces(spark.createDataFrame(pieces, "CHROM string, begin long, bases string"), WIDTH).cache()


def whole(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.CHROM, r.block)):
        out[r.CHROM] = out.get(r.CHROM, "") + r.bases
    return out


def test_pieces(reference):
    assert whole(reference) == CONTIGS
    assert reference.where(F.length("bases") > WIDTH).count() == 0


@pytest.mark.parametrize("split", [40, 100, 10_000])
def test_fasta_at_any_split(spark, tmp_path, split):
    text = "".join(f">{n} about it\n" + "".join(s[i : i + k] + "\n" for i in range(0, len(s), k)) + "\n" for (n, s), k in zip(CONTIGS.items(), (7, 60, 5), strict=True))
    (tmp_path / "r.fa").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        assert whole(Q.read_fasta(spark, str(tmp_path / "r.fa"), WIDTH)) == CONTIGS
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fetch(spark, reference):
    rows = [(c, b, e, "x") for c in (*CONTIGS, "none") for b, e in [(1, 1), (1, 500), (15, 18), (16, 16), (17, 17), (33, 80), (0, 3), (-5, 0), (9, 8), (600, 700), (None, 3)]]
    got = Q.fetched(spark.createDataFrame(rows, "CHROM string, b long, e long, block string"), reference, F.col("b"), F.col("e"), "found", WIDTH).collect()
    want = lambda c, b, e: None if b is None else CONTIGS.get(c, "")[max(b, 1) - 1 : max(e, 0)] or None
    assert len(got) == len(rows) and all(r.found == want(r.CHROM, r.b, r.e) and r.block == "x" for r in got)


def test_fill(spark, reference):
    df = spark.createDataFrame([("a", 3, "NNN", "t"), ("a", 15, "NN", None), ("z", 1, "N", "u")], "CHROM string, POS long, REF string, AA string")
    got = sorted(map(tuple, Q.filled_from_reference(df, reference, width=WIDTH).select("POS", "REF").collect()))
    assert got == [(1, "N"), (3, CONTIGS["a"][2:5]), (15, CONTIGS["a"][14:16])]
    got = sorted(map(tuple, Q.filled_from_reference(df, reference, "AA", F.col("AA").isNull(), width=WIDTH).select("POS", "AA").collect()))
    assert got == [(1, "u"), (3, "t"), (15, CONTIGS["a"][14:16])]


def brute_left(s, pos, alleles):
    alleles = list(alleles)
    if len(set(map(len, alleles))) > 1:
        while len({a[-1].upper() for a in alleles}) == 1 and not (pos == 1 and min(map(len, alleles)) == 1):
            if min(map(len, alleles)) == 1:
                pos -= 1
                alleles = [s[pos - 1] + a for a in alleles]
            alleles = [a[:-1] for a in alleles]
    while min(map(len, alleles)) > 1 and len({a[-1].upper() for a in alleles}) == 1:
        alleles = [a[:-1] for a in alleles]
    while min(map(len, alleles)) > 1 and len({a[0].upper() for a in alleles}) == 1:
        pos, alleles = pos + 1, [a[1:] for a in alleles]
    return pos, alleles


def test_left_alignment(spark, reference):
    sites = []
    for c, s in CONTIGS.items():
        for _ in range(150):
            pos = rng.randint(1, len(s))
            ref = s[pos - 1 : pos - 1 + rng.choice([1, 1, 2, 3, 7, 13])]
            kind = rng.random()
            alt = ref[0] if kind < 0.4 else ref + "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 4))) if kind < 0.5 else s[pos - 1 : pos + rng.randint(1, 9)] + ref[1:] if kind < 0.8 else "".join(rng.choice("ACGT") for _ in ref)
            alts = [alt, *([ref + ref] if rng.random() < 0.2 else [])]
            sites.append((c, pos, ref, alts))
    sites += [("a", 5, "A", ["<DEL>"]), ("a", 6, "AC", []), ("none", 5, "AC", ["A"]), ("a", 116, CONTIGS["a"][115:117], ["*"]), ("a", None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(sites)], "i long, CHROM string, POS long, REF string, ALT array<string>")
    got = {r.i: (r.CHROM, r.POS, r.REF, r.ALT) for r in Q.left_aligned(df, reference, WIDTH).collect()}
    moved = 0
    for i, (c, pos, ref, alts) in enumerate(sites):
        if c in CONTIGS and alts and "<DEL>" not in alts and "*" not in alts:
            p, al = brute_left(CONTIGS[c], pos, [ref, *alts])
            assert got[i] == (c, p, al[0], al[1:]), (i, c, pos, ref, alts)
            moved += pos - p > 2 * WIDTH
        else:
            assert got[i] == (c, pos, ref, alts)
    assert moved > 5


def brute_consensus(s, edits):
    out, at, end = [], 0, 0
    for pos, ref, new in sorted(edits):
        if new is None or new == ref or pos <= end:
            continue
        out += [s[at : pos - 1], new]
        at = end = pos - 1 + len(ref)
    return "".join(out) + s[at:]


def test_consensus(spark, reference):
    edits = {c: [] for c in CONTIGS}
    for c, s in CONTIGS.items():
        for _ in range(len(s) // 6):
            pos = rng.randint(1, len(s))
            ref = s[pos - 1 : pos - 1 + rng.choice([1, 1, 2, 5, 40])]
            edits[c].append((pos, ref, rng.choice([ref[0], "", "TTTT", None, ref, "G" * 40])))
    df = spark.createDataFrame([(c, *e) for c, own in edits.items() for e in own], "CHROM string, POS long, REF string, new string").repartition(3)
    made = Q.consensus(df, reference, width=WIDTH)
    rows = sorted(made.collect(), key=lambda r: (r.CHROM, r.block))
    assert whole(made) == {c: brute_consensus(s, edits[c]) for c, s in CONTIGS.items()}
    at = {}
    for r in rows:
        assert r.begin == at.get(r.CHROM, 0)
        at[r.CHROM] = r.begin + len(r.bases)
    assert whole(Q.consensus(df.where("false"), reference, width=WIDTH)) == CONTIGS


def test_masked_consensus(spark, reference):
    df = spark.createDataFrame([("b", 3, "G", "T"), ("b", 20, "AGAGA", "A"), ("b", 40, "A", "C")], "CHROM string, POS long, REF string, new string")
    mask = spark.createDataFrame([("b", 10, 20), ("b", 60, 500)], "CHROM string, b long, e long")
    s = CONTIGS["b"]
    for how, hidden in (("N", lambda x: "N" * len(x)), ("lc", str.lower)):
        got = whole(Q.consensus(df, reference, mask, how, WIDTH))["b"]
        assert got == s[:2] + "T" + s[3:9] + hidden(s[9:20]) + s[20:39] + "C" + s[40:59] + hidden(s[59:])


def test_alleles_of_haplotypes(spark):
    samples = [{"sample_id": i, "GT": g} for i, g in enumerate(["0|1", "1|0", "0/0", "1/2", "./1", "2", "."])]
    df = spark.createDataFrame([("A", ["C", "GT"], samples)], "REF string, ALT array<string>, samples array<struct<sample_id:int,GT:string>>")
    want = {"1": [None, "C", None, "C", None, "GT", None], "2": ["C", None, None, "GT", "C", "GT", None], "A": ["C", "C", None, "C", "C", "GT", None], "R": [None, None, None, "C", "C", "GT", None], "I": ["M", "M", None, "C", "C", "GT", None]}
    for how, alleles in want.items():
        assert [df.select(Q.chosen_allele(how, i)).first()[0] for i in range(7)] == alleles, how
    assert df.select(Q.chosen_allele("alt")).first()[0] == "C"
