"""The cohort queries over all sites, against brute force."""

from collections import defaultdict
from math import comb

import pytest

import __spark_entry__ as entry
from lociframe.operators import cohort
from lociframe.plans.derive import genotypes, nested

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tidy(spark):
    return [tuple(r) for r in genotypes(spark, DIR).select("site_id", "CHROM", "POS", "sample_id", "GT").collect()]


def test_ad_bias_all(spark):
    got = {r.site_id: r.p for r in entry.queries()["ad_bias_all"](spark, DIR).collect()}
    rows = nested(spark, DIR).select("site_id", "samples").collect()
    assert len(got) == len(rows)
    for r in rows:
        ad = {s.sample_id: s.AD for s in r.samples}
        (a, b), (c, e) = ad[0][:2], ad[1][:2]
        w = {i: comb(a + b, i) * comb(c + e, a + c - i) for i in range(max(0, a - e), min(a + b, a + c) + 1)}
        assert abs(got[r.site_id] - min(1, sum(x for x in w.values() if x <= w[a] * (1 + 1e-7)) / sum(w.values()))) < 2e-6


def test_check_sparsity_all(spark, tidy):
    called, sites = defaultdict(int), defaultdict(set)
    for site, chrom, _, sample, gt in tidy:
        called[sample, chrom] += gt != "./."
        sites[chrom].add(site)
    got = sorted(map(tuple, entry.queries()["check_sparsity_all"](spark, DIR).collect()))
    assert got and got == sorted((s, c, n, len(sites[c])) for (s, c), n in called.items() if n < 0.9 * len(sites[c]))
    small = spark.createDataFrame([(1, "a", 0, "0/1"), (1, "a", 1, "./."), (2, "a", 0, "0/0"), (3, "b", 0, "0/0"), (3, "b", 1, "0/0"), (3, "b", 2, "0/1")], "site_id long, CHROM string, sample_id int, GT string")
    assert sorted(map(tuple, cohort.sparse_share(small, 0.6).collect())) == [(1, "a", 0, 2), (2, "a", 0, 2)]


def test_ld_r2_all(spark):
    larger = "/root/testdata/sf0.01"  # the smallest table has no sites so near each other
    tidy = [tuple(r) for r in genotypes(spark, larger).select("site_id", "CHROM", "POS", "sample_id", "GT").collect()]
    dose, want = defaultdict(dict), {}
    for _, chrom, pos, sample, gt in tidy:
        dose[chrom, pos][sample] = {"0/0": 0, "0/1": 1, "1/1": 2}.get(gt)
    places = defaultdict(list)
    for chrom, pos in sorted(dose):
        places[chrom].append(pos)
    for chrom, at in places.items():
        for i, p in enumerate(at):
            for q in at[i + 1 :]:
                if q - p > 100:
                    break
                xy = [(x, dose[chrom, q].get(s)) for s, x in dose[chrom, p].items() if x is not None and dose[chrom, q].get(s) is not None]
                n, sx, sy = len(xy), sum(x for x, _ in xy), sum(y for _, y in xy)
                cov, vx, vy = n * sum(x * y for x, y in xy) - sx * sy, n * sum(x * x for x, _ in xy) - sx * sx, n * sum(y * y for _, y in xy) - sy * sy
                if n:
                    want[chrom, p, q] = n, round(cov * cov / (vx * vy), 6) if vx > 0 and vy > 0 else None
    got = {(r.CHROM, r.pos1, r.pos2): (r.n, r.r2) for r in entry.queries()["ld_r2_all"](spark, larger).collect()}
    assert got.keys() == want.keys() and len({c for c, _, _ in got}) > 1
    assert all(got[k][0] == n and (got[k][1] is None) == (r2 is None) and abs((r2 or 0) - (got[k][1] or 0)) < 2e-6 for k, (n, r2) in want.items())
