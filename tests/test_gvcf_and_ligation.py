"""gVCF merging position by position, and chunks cut and turned at random that come back in phase."""

import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import gvcf, ligation, sequence

SCHEMA = "CHROM string, POS long, REF string, ALT array<string>, INFO_END int, INFO_DP int, samples array<struct<sample_id:string,GT:string,DP:int,PL:array<int>>>"
WIDTH = 16


def call_set(rng, n, length, contig="c"):
    out, at = [], rng.randint(1, 9)
    while at < length:
        kind = rng.random()
        calls = lambda g, k: [(f"s{i}", g(), rng.randrange(99), [rng.randrange(99) for _ in range(k)]) for i in range(n)]  # noqa: E731, B023
        if kind < 0.25:
            at += rng.randint(1, 30)
        elif kind < 0.7:
            end = at + rng.choice([0, 1, 3, 15, 16, 40, 100])
            out.append((contig, at, "A", ["<*>"] if rng.random() < 0.8 else [], end, at % 50, calls(lambda: "0/0", 3)))
            at = end + 1
        else:
            out.append((contig, at, "AT" if rng.random() < 0.3 else "A", [rng.choice("CG"), "<*>"], None, at % 50, calls(lambda: rng.choice(["0/1", "1/1", "0/0"]), 6)))
            at += 1
    return [(*r[:3], r[3] if r[3] else [], *r[4:]) for r in out]


def brute(sets, length):
    """{position: tuple of what holds there, by set}."""
    out = {}
    for p in range(1, length + 200):
        held = []
        for s in sets:
            here = [r for r in s if r[1] == p and r[4] is None] or [r for r in s if r[4] is not None and r[1] <= p <= r[4]]
            held.append(here[0] if here else None)
        if any(held):
            out[p] = held
    return out


@pytest.mark.parametrize("width", [16, 1024, 7])
def test_merge_gvcf(spark, width):
    rng = random.Random(width)
    sets = [call_set(rng, 2, 400), call_set(rng, 1, 300), call_set(rng, 1, 500)]
    frames = [spark.createDataFrame(s, SCHEMA).repartition(2) for s in sets]
    rows = sorted(gvcf.merge_gvcf(*frames, width=width, info_rules={"INFO_DP": "sum"}).collect(), key=lambda r: r.POS)
    want, seen, boundaries = brute(sets, 500), set(), set()
    for s in sets:
        for r in s:
            boundaries |= {r[1], (r[4] or r[1]) + 1}
    for r in rows:
        end = r.INFO_END or r.POS
        variant = any(x is not None and x[4] is None for x in want[r.POS])
        assert (r.INFO_END is None) == variant and (not variant or end == r.POS)
        assert r.POS in boundaries and end + 1 in boundaries and not any(b in boundaries for b in range(r.POS + 1, end + 1))
        for p in range(r.POS, end + 1):
            assert p not in seen
            seen.add(p)
            calls = []
            for s, x in zip(sets, want[p], strict=True):
                n = len(s[0][6])
                if x is None:
                    calls += [("./.", None)] * n
                else:
                    calls += [(g, d) for _, g, d, _ in x[6]]
            if not variant:
                assert [(x.GT, x.DP) for x in r.samples] == calls
            else:
                assert [x.DP for x in r.samples] == [d for _, d in calls] and [x.GT == "./." for x in r.samples] == [g == "./." for g, _ in calls]
        begins = [x for x in want[r.POS] if x is not None and x[1] == r.POS]
        assert r.REF == (max((x[2] for x in begins), key=len) if begins else "N")
        assert r.INFO_DP == sum(x[5] for x in want[r.POS] if x is not None)
    assert seen == set(want)
    # PL of a block at another set's variant: its value of <*> for the ALT
    for r in rows:
        if r.INFO_END is None and r.ALT[:1] != ["<*>"] and len(r.ALT) == 2:
            x = want[r.POS][2]
            if x is not None and x[4] is not None and x[3]:
                rr, ra, aa = x[6][0][3]
                assert r.samples[3].PL == [rr, ra, aa, ra, aa, aa]


def test_reference_bases_of_pieces(spark):
    bases = "".join(random.Random(1).choice("CGT") for _ in range(120))
    reference = sequence.in_pieces(spark.createDataFrame([("c", 0, bases)], "CHROM string, begin long, bases string"), WIDTH)
    a = spark.createDataFrame([("c", 1, "A", [], 100, 1, [("a", "0/0", 1, None)])], SCHEMA)
    b = spark.createDataFrame([("c", 40, "A", ["G"], None, 1, [("b", "0/1", 1, None)])], SCHEMA)
    rows = sorted(gvcf.merge_gvcf(a, b, reference=reference, reference_width=WIDTH, width=32).collect(), key=lambda r: r.POS)
    assert [(r.POS, r.INFO_END, r.REF, r.ALT) for r in rows] == [(1, 39, "A", []), (40, None, "A", ["G"]), (41, 100, bases[40], [])]
    assert [x.GT for x in rows[1].samples] == ["0/0", "0/1"]


LIG = "CHROM string, POS long, REF string, ALT array<string>, chunk int, samples array<struct<sample_id:int,GT:string>>"


def phased(rng):
    rows = []
    for c in ("x", "y"):
        at = 0
        for _ in range(120):
            at += rng.choice([0, 1, 2, 9])
            gts = [rng.choice(["0|1", "1|0", "0|0", "1|1", "0/1", "1|2", "2|1", "./.", "1"]) for _ in range(4)]
            rows.append((c, at, "A", [rng.choice(["C", "G"]), "T"], gts))
    return list({r[:2] + (tuple(r[3]),): r for r in rows}.values())


def flip(g):
    a = g.split("|")
    return "|".join(a[::-1]) if len(a) == 2 and "/" not in g else g


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chunks_come_back_in_phase(spark, seed):
    rng = random.Random(seed)
    rows = phased(rng)
    out = []
    for c in ("x", "y"):
        own = sorted(r for r in rows if r[0] == c)
        begin = 0
        for k in range(4):
            end = len(own) if k == 3 else begin + 40
            turn = [k > 0 and rng.random() < 0.5 for _ in range(4)]
            last = own[end - 1][1]
            low = own[begin][1]
            for r in own:
                if low <= r[1] <= last:
                    out.append((*r[:4], k, [(i, flip(g) if t else g) for i, (g, t) in enumerate(zip(r[4], turn, strict=True))]))
            begin = end - 18
    df = spark.createDataFrame(out, LIG).repartition(3)
    for keep in (True, False):
        got = sorted((r.CHROM, r.POS, r.REF, r.ALT, [s.GT for s in r.samples]) for r in ligation.ligated(df, keep).collect())
        assert got == sorted((*r[:3], r[3], list(r[4])) for r in rows)


def test_unshared_sites_and_ties(spark):
    s = lambda *g: [(i, x) for i, x in enumerate(g)]
    rows = [("x", 1, "A", ["C"], 0, s("0|1")), ("x", 5, "A", ["C"], 0, s("0|1")), ("x", 7, "A", ["C"], 0, s("0|1")), ("x", 9, "A", ["C"], 0, s("1|0")), ("x", 5, "A", ["C"], 1, s("1|0")), ("x", 6, "A", ["C"], 1, s("0|1")), ("x", 9, "A", ["C"], 1, s("0|1")), ("x", 12, "A", ["C"], 1, s("0|1")), ("x", 20, "A", ["C"], 2, s("0|1"))]
    df = spark.createDataFrame(rows, LIG)
    got = lambda keep: sorted((r.POS, r.samples[0].GT) for r in ligation.ligated(df, keep).collect())
    assert got(True) == [(1, "0|1"), (5, "0|1"), (7, "0|1"), (9, "1|0"), (12, "1|0"), (20, "0|1")]
    assert got(False) == [(1, "0|1"), (5, "0|1"), (9, "1|0"), (12, "1|0"), (20, "0|1")]
    assert ligation.ligated(df.where("false")).count() == 0
