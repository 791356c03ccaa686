"""Scores from genotype likelihoods against sums over all genotypes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import aggregates, trios

SCHEMA = "CHROM string, POS long, ALT array<string>, AF array<double>, samples array<struct<sample_id:int,GT:string,PL:array<int>,AD:array<int>>>"


def rows(n=40, people=4):
    rng, out = random.Random(12), []
    for p in range(n):
        alts = [["C"], ["C", "G"], ["C", "G", "T"], []][p % 4] if p % 8 > 3 else ["C"]
        k = len(alts) + 1
        calls = []
        for i in range(people):
            pl = [rng.randrange(80) for _ in range(k * (k + 1) // 2)]
            pl = None if rng.random() < 0.1 else [None, *pl[1:]] if rng.random() < 0.05 else pl
            calls.append((i, rng.choice(["0/0", "0/1", "1/1", "1|0", "./."]), pl, [rng.randrange(30), rng.randrange(30)]))
        out.append(("c", p + 1, alts, [round(rng.uniform(0.05, 0.25), 3) for _ in alts], calls))
    return out


@pytest.mark.parametrize("prior", [False, True])
def test_de_novo_brute(spark, prior):
    data, mu, family = rows(), 1e-4, [(2, 0, 1), (3, 1, 0)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r.POS, r.child): r for r in trios.de_novo_scores(df, family, mutation=mu, frequencies="AF" if prior else None).collect()}
    want = 0
    for _, pos, alts, af, calls in data:
        n = len(alts) + 1
        pairs = [(a, b) for b in range(n) for a in range(b + 1)]
        q = [1 - sum(af), *af]
        for c, f, m in family:
            pls = [calls[x][2] for x in (c, f, m)]
            if not alts or any(p is None or None in p for p in pls):
                assert (pos, c) not in got
                continue
            none = some = 0.0
            best = {}
            for i, gf in enumerate(pairs):
                for j, gm in enumerate(pairs):
                    w = 10 ** (-pls[1][i] / 10 - pls[2][j] / 10)
                    if prior:
                        w *= math.prod(q[g[0]] * q[g[1]] * (1 if g[0] == g[1] else 2) for g in (gf, gm))
                    for x in gf:
                        for y in gm:  # each with probability 1/4
                            for x2 in range(n):
                                for y2 in range(n):
                                    p = 0.25 * (1 - mu if x2 == x else mu / (n - 1)) * (1 - mu if y2 == y else mu / (n - 1))
                                    g = (min(x2, y2), max(x2, y2))
                                    v = w * p * 10 ** (-pls[0][pairs.index(g)] / 10)
                                    if (x, y) == (x2, y2):
                                        none += v
                                    else:
                                        some += v
                                        best[g] = best.get(g, 0) + v
            r = got[pos, c]
            assert math.isclose(r.p_dnm, some / (some + none), rel_tol=1e-9) and math.isclose(r.log_odds, math.log10(some / none), rel_tol=1e-9, abs_tol=1e-9)
            top = max(best.values())
            assert math.isclose(best[tuple(map(int, r.dnm_alleles.split("/")))], top, rel_tol=1e-9)
            want += 1
    assert len(got) == want > 20


def test_a_clear_mutation_and_a_clear_inheritance(spark):
    pl = lambda k: [0 if i == k else 200 for i in range(3)]
    make = lambda c, f, m: [(0, "0/0", pl(f), None), (1, "0/0", pl(m), None), (2, "0/1", pl(c), None)]
    df = spark.createDataFrame([("c", 1, ["C"], None, make(1, 0, 0)), ("c", 2, ["C"], None, make(1, 1, 0)), ("c", 3, ["C"], None, make(2, 0, 2))], SCHEMA)
    got = {r.POS: (r.p_dnm, r.dnm_alleles) for r in trios.de_novo_scores(df, [(2, 0, 1)]).collect()}
    assert got[1][0] > 0.999 and got[1][1] == "0/1" and got[2][0] < 1e-6 and got[3][0] > 0.999


def test_parental_origin_brute(spark):
    data = rows(200)
    df = spark.createDataFrame(data, SCHEMA)
    regions = [(1, "c", 1, 50), (2, "c", 40, 120), (3, "c", 199, 500), (4, "x", 1, 500)]
    reg = spark.createDataFrame(regions, "region int, c string, b long, e long")
    share = {"0/0": 0, "0/1": 0.5, "1|0": 0.5, "1/1": 1}
    for kind in ("del", "dup"):
        got = {(r.region, r.child): r for r in trios.parental_origin(df, reg, [(2, 0, 1)], kind, 0.02, bin_size=16).collect()}
        want = {}
        for i, c, b, e in regions:
            n, total = 0, 0.0
            for chrom, pos, alts, _, calls in data:
                f, m, k = (share.get(calls[x][1]) for x in (0, 1, 2))
                if chrom != c or not b <= pos <= e or len(alts) != 1 or f is None or m is None or f == m:
                    continue
                if kind == "del":
                    if k not in (0, 1):
                        continue
                    p = lambda t: 0.98 * (t if k else 1 - t) + 0.02 * (1 - t if k else t)  # noqa: E731, B023
                    total += math.log(p(m)) - math.log(p(f))
                else:
                    if abs(f - m) != 1:
                        continue
                    ref, alt = calls[2][3]
                    p, q = (2 / 3, 1 / 3) if f == 1 else (1 / 3, 2 / 3)
                    total += alt * math.log(p / q) + ref * math.log((1 - p) / (1 - q))
                n += 1
            if n:
                want[i, 2] = n, total
        assert got.keys() == want.keys() and want
        for key, (n, total) in want.items():
            assert got[key].n_markers == n and math.isclose(got[key].log_ratio, total, rel_tol=1e-9, abs_tol=1e-9)
            assert got[key].origin == ("paternal" if total > 1e-12 else "maternal" if total < -1e-12 else got[key].origin)
    with pytest.raises(ValueError, match="no such kind"):
        trios.parental_origin(df, reg, [(2, 0, 1)], "inv")


@pytest.mark.parametrize(("field", "width"), [(None, 2048), (None, 2), ("PL", 3)])
def test_discordance_scores_brute(spark, field, width):
    data = [r for r in rows(60, 5) if len(r[2]) == 1]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = {(r.a, r.b): r for r in aggregates.discordance_scores(df, F.get("AF", F.lit(0)), field, 30.0, width).collect()}
    assert len(got) == 10
    dose = {"0/0": 0, "0/1": 1, "1|0": 1, "1/1": 2}
    for a in range(5):
        for b in range(a + 1, 5):
            n = match = 0
            score = hwe = 0.0
            for _, _, _, (f,), calls in data:
                ls = []
                for s in (a, b):
                    _, g, pl, _ = calls[s]
                    if field:
                        ls.append(None if pl is None or None in pl else [10 ** (-x / 10) for x in pl])
                    else:
                        ls.append(None if g not in dose else [1.0 if k == dose[g] else 1e-3 for k in range(3)])
                if None in ls:
                    continue
                n += 1
                score -= math.log(sum(x * y for x, y in zip(*ls, strict=True)))
                x, y = (v.index(max(v)) for v in ls)
                if x == y:
                    match += 1
                    hwe -= math.log([(1 - f) ** 2, 2 * f * (1 - f), f * f][x])
            r = got[a, b]
            assert (r.n_sites, r.n_match) == (n, match) and math.isclose(r.score, score, rel_tol=1e-9) and math.isclose(r.hwe, hwe, rel_tol=1e-9)
