"""The blockwise model against sequential Viterbi and forward-backward, at any block size."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import autozygosity as Z

SCHEMA = "CHROM string, POS long, ALT array<string>, AF double, samples array<struct<sample_id:string,GT:string,PL:array<int>>>"
TO_AZ, TO_HW = 2e-3, 1e-3


def rows():
    rng, out = random.Random(9), []
    for c in ("x", "y"):
        at = 0
        for i in range(180):
            at += rng.choice([0, 1, 3, 10, 60]) if i else 5
            f = rng.choice([0.1, 0.4, 0.5, 0.9])
            calls = []
            for s in range(3):
                quiet = (i // 45) % 2 == 0 if s == 0 else s == 1 and c == "x"
                a, b = rng.random() < f, rng.random() < f
                g = f"{int(a)}/{int(a if quiet else b)}"
                g = rng.choice(["./.", ".", "1"]) if rng.random() < 0.1 else g
                calls.append((f"s{s}", g, None if rng.random() < 0.05 else [rng.randrange(60) for _ in range(3)]))
            out.append((c, at, ["C", "G"] if i % 31 == 7 else ["C"], 0.0 if i % 29 == 3 else f, calls))
    return out


def steps(d, rate):
    a, b = TO_AZ, TO_HW
    if rate is None:
        m = (1 - (1 - a - b) ** max(d, 1)) / (a + b)
    else:
        m = min(1.0, max(d, 1) * rate)
    return [[1 - a * m, a * m], [b * m, 1 - b * m]]


def brute(data, field, rate):
    """{(sample, contig): [(POS, state, quality)]}, one site after another."""
    out = {}
    for c in ("x", "y"):
        for s in range(3):
            seq = []
            for chrom, pos, alts, f, calls in data:
                if chrom != c or len(alts) != 1 or f <= 0:
                    continue
                _, g, pl = calls[s]
                if field == "GT":
                    if "." in g or len(g) == 1:
                        continue
                    n = g.count("1")
                    p = [1.0 if n == k else 1e-3 for k in range(3)]
                else:
                    if pl is None:
                        continue
                    p = [10 ** (-x / 10) for x in pl]
                seq.append((pos, [(1 - f) ** 2 * p[0] + 2 * f * (1 - f) * p[1] + f * f * p[2], (1 - f) * p[0] + f * p[2]]))
            v, back = None, []
            ahead = []
            for i, (pos, o) in enumerate(seq):
                if i == 0:
                    v = [math.log(0.5) + math.log(x) for x in o]
                    w = [0.5 * x for x in o]
                    back.append([0, 0])
                else:
                    t = steps(pos - seq[i - 1][0], rate)
                    came = [max((0, 1), key=lambda k: v[k] + math.log(t[k][j])) for j in (0, 1)]
                    v = [v[came[j]] + math.log(t[came[j]][j]) + math.log(o[j]) for j in (0, 1)]
                    w = [sum(w[k] * t[k][j] for k in (0, 1)) * o[j] for j in (0, 1)]
                    back.append(came)
                w = [x / sum(w) for x in w]
                ahead.append(w)
            states, k = [], int(v[1] > v[0])
            for came in reversed(back):
                states.append(k)
                k = came[k]
            states.reverse()
            w, quality = [1.0, 1.0], [0.0] * len(seq)
            for i in range(len(seq) - 1, -1, -1):
                both = [ahead[i][k] * w[k] for k in (0, 1)]
                p = both[1 - states[i]] / sum(both)
                quality[i] = min(99.0, -10 * math.log10(max(p, 1e-300)))
                if i:
                    t = steps(seq[i][0] - seq[i - 1][0], rate)
                    w = [sum(t[k][j] * seq[i][1][j] * w[j] for j in (0, 1)) for k in (0, 1)]
                    w = [x / sum(w) for x in w]
            out[f"s{s}", c] = [(p, x, q) for (p, _), x, q in zip(seq, states, quality, strict=True)]
    return out


@pytest.mark.parametrize(("field", "rate", "block"), [("GT", None, 37), ("GT", None, 10**6), ("PL", None, 100), ("GT", 0.01, 250), ("GT", None, 1)])
def test_states_and_runs(spark, field, rate, block):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    seen = Z.observations(df, F.col("AF"), None if field == "GT" else "PL")
    want = brute(data, field, rate)
    got = {}
    for r in Z.autozygosity(seen, TO_AZ, TO_HW, rate, per_site=True, block=block).collect():
        got.setdefault((r.sample_id, r.CHROM), []).append((r.POS, r.state, r.quality))
    shared = lambda x: {p for p, _, _ in x if sum(q == p for q, _, _ in x) > 1}  # noqa: E731  sites of one position may come in any order
    assert got.keys() == want.keys()
    for key, sites in want.items():
        double = shared(sites)
        a, b = (sorted(x for x in s if x[0] not in double) for s in (got[key], sites))
        assert [x[:2] for x in a] == [x[:2] for x in b]
        assert all(abs(x[2] - y[2]) < 0.05 * max(1, y[2]) for x, y in zip(a, b, strict=True)) or double
    runs = {}
    for (s, c), sites in want.items():
        inside = False
        for p, x, q in sites:
            if x == 1:
                if not inside:
                    runs.setdefault((s, c), []).append([p, p, 0, 0.0])
                run = runs[s, c][-1]
                run[1], run[2], run[3] = p, run[2] + 1, run[3] + q
            inside = x == 1
    found = {}
    for r in Z.autozygosity(seen, TO_AZ, TO_HW, rate, block=block).collect():
        found.setdefault((r.sample_id, r.CHROM), []).append([r.begin, r.end, r.n])
    assert {k: sorted(v) for k, v in found.items()} == {k: [x[:3] for x in v] for k, v in runs.items()} and sum(map(len, runs.values())) >= 3


def test_no_sites(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert Z.autozygosity(Z.observations(df, F.col("AF"))).count() == 0
