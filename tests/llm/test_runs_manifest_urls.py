"""Periodic runs, Merkle manifests and URL filters against brute force and on awkward rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.llm import merkle_manifest, periodic_runs, url_filters

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, runs string, pos long, n long, tree string, row long, host string, verdict string"
CLASH = ("x", "y", None, 3, "t", 1, "h", "v")


def brute_runs(w, exponent, shortest):
    out = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            seg = w[i : i + n]
            if n >= max(shortest, exponent * q) and not any(seg[:-r] == seg[r:] for r in range(1, q)):
                out.add((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts():
    rng = random.Random(5)
    out = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b " * 40, "x " * 3000, "a\x1ca a\x85a", "né né né né né né"]
    for _ in range(60):
        n, size = rng.randint(1, 120), rng.choice([1, 2, 3, 30])
        w = [rng.choice("abcdefghijklmnopqrstuvwxyzäöüßéèABC")[:1] * rng.randint(1, 2) if size > 3 else "ab"[: 1 + rng.randrange(size) % 2] for _ in range(n)]
        a, p = rng.randrange(n), rng.randint(1, 20)
        out.append(rng.choice([" ", "\n", "  \t"]).join(w if rng.random() < 0.4 else [w[i] if i < a else w[a + (i - a) % p] if a + (i - a) % p < n else "z" for i in range(n)]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 7 else None, t, "en", None if i % 4 == 0 else f"s{i % 3}", None if i % 5 == 0 else i, *CLASH) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[6], rows[6], (6, "other text", *rows[6][2:])], SCHEMA).repartition(3).cache()


@pytest.mark.parametrize(("exponent", "shortest"), [(2, 2), (3, 2), (4, 6)])
def test_catchers_at_once_and_word_by_word(exponent, shortest):
    rng = random.Random(exponent)
    for _ in range(200):
        n, size = rng.randint(0, 90), rng.choice([1, 2, 2, 3])
        w = [rng.randrange(size) for _ in range(n)]
        want = brute_runs(w, exponent, shortest)
        whole, online = periodic_runs.Catchers(exponent, shortest), periodic_runs.Catchers(exponent, shortest)
        whole.append(np.array(w, np.int64))
        for x in w:
            online.append(np.array([x], np.int64))
        assert [*map(tuple, whole.runs().tolist())] == [*map(tuple, online.runs().tolist())] == want


def test_op11_brute(docs):
    got = {}
    for r in periodic_runs.word_runs(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    want = {}
    for r in docs.collect():
        w = (r.text or "").encode().split()
        found = brute_runs(w, 4, 6)
        gone = {i for a, n, q in found for i in range(a + q, a + n)}
        want.setdefault(r.doc_id, []).append((len(w), found, b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(len(x[1]) > 0 for v in want.values() for x in v) > 10


def test_op11_groups_do_not_matter():
    both = []
    for size in (1, 10**9):
        groups = periodic_runs._grouped(["a b a b a b a b", "b", "", "a a a a a a a"], size)
        both.append([tuple(r) for _, held in groups for r in periodic_runs._runs_of(held, 4, 6)[0].tolist()])
    assert both == [[(0, 8, 2), (0, 7, 1)]] * 2


def test_longest_by_period_takes_the_first_of_equal_ones(spark):
    runs = [(0, 8, 2), (20, 12, 3), (50, 13, 3), (90, 26, 6)]
    df = spark.createDataFrame([(runs,), ([],), (None,)], "r array<struct<start:long,length:long,period:long>>")
    assert [x and tuple(x) for (x,) in df.select(periodic_runs.longest_by_period(F.col("r"))).collect()] == [(50, 13, 3), None, None]


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert periodic_runs.word_runs(none).count() == 0
    manifest = merkle_manifest.build_manifest(none.withColumn("d", F.lit("00")), F.col("source"), ["doc_id"], F.col("d"))
    assert manifest.root is None and merkle_manifest.proofs(manifest).count() == 0
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    assert url_filters.filter_urls(none.select("doc_id", F.col("text").alias("url")), rules).count() == 0


# --- manifests -------------------------------------------------------------------------------------------------------


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def brute_proofs(leaves, arity):
    """{(tree, place): (subroot, root, proof)} for (tree, order, leaf) rows."""
    trees = {}
    for tree, _, leaf in sorted(leaves, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        trees.setdefault(tree, [[]])[0].append(leaf)
    for levels in trees.values():
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    top = [[levels[-1][0] for levels in trees.values()]]
    while len(top[-1]) > 1:
        top.append([h(*top[-1][i : i + arity]) for i in range(0, len(top[-1]), arity)])
    out = []
    for t, levels in enumerate(trees.values()):
        for i in range(len(levels[0])):
            proof = []
            for part, j in ((levels, i), (top, t)):
                for level in part[:-1]:
                    f = j // arity * arity
                    proof.append(("".join(level[f:j]), "".join(level[j + 1 : f + arity])))
                    j //= arity
            out.append((levels[0][i], levels[-1][0], top[-1][0], proof))
    return sorted(out)


@pytest.mark.parametrize(("arity", "every"), [(3, 4), (3, 1), (2, 3)])
def test_op12_brute(docs, arity, every):
    leaves = docs.withColumn("d", merkle_manifest.leaf_digest(F.col("doc_id"), F.col("source"), F.col("text")))
    manifest = merkle_manifest.build_manifest(leaves, F.col("source"), ["doc_id"], F.col("d"), ["lang"], arity, every)
    found = merkle_manifest.proofs(manifest)
    got = sorted((r.leaf, r.subroot, manifest.root, [tuple(s) for s in r.proof]) for r in found.collect())
    assert got == brute_proofs([(r.source, r.doc_id, r.d) for r in leaves.collect()], arity)
    assert found.where(merkle_manifest.folded(F.col("leaf"), F.col("proof")) != manifest.root).count() == 0
    assert found.where(merkle_manifest.folded(F.sha2(F.col("leaf").cast("binary"), 256), F.col("proof")) == manifest.root).count() == 0


def test_op12_trees_of_all_small_sizes(spark):
    sizes = [1, 2, 3, 4, 9, 10, 27, 28, 82]
    df = spark.createDataFrame([(f"t{n}", i, h(f"{n},{i}")) for n in sizes for i in range(n)], "source string, i long, d string")
    for every in (1, 2, 4):
        m = merkle_manifest.build_manifest(df, F.col("source"), ["i"], F.col("d"), every=every)
        got = sorted((r.leaf, r.subroot, m.root, [tuple(s) for s in r.proof]) for r in merkle_manifest.proofs(m).collect())
        assert got == brute_proofs([tuple(r) for r in df.collect()], 3)


def test_leaf_digest_tells_nulls_and_borders_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("-", "a"), ("", "a"), ("a", None), ("1:", "é"), ("1", ":é")], "a string, b string")
    got = [r[0] for r in df.select(merkle_manifest.leaf_digest(F.col("a"), F.col("b"))).collect()]
    assert len(set(got)) == 6 and got[0] == h("-", "1:a") and got[4] == h("2:1:", "2:é")


# --- urls ------------------------------------------------------------------------------------------------------------

URLS = [None, "", "no scheme/at all", "http://", "http://Example.ORG/es/1", "https://a.example.org/en/12?x=://b.com/de/", "http://xexample.org/es/", "http://b.com", "http://b.com?/de/", "http://www.B.com/de/#f", "x://y://com/de/", "http://CASINO-win.net/p", "http://www.org.net/es/\nzwei", "http://com/fr/ü?é", "http://É.com/de/ß", "http://.org/", "http://org:80/", "http://best-bets.fr", "http://m.example.org/en/1", "http://m.example.org/en/"]
RULES = [*url_filters.RULES, ("block", "ORG", "/"), (None, "x.org", "/"), ("block", None, "/"), ("allow", "www.b.com", None), ("block", "b.com", "/de/#"), ("allow", "casino-win.net", "/p"), ("block", "a.example.org", "/en/12"), ("allow", "é.com", "/de/ß")]


def brute_verdict(url, rules, words):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = {}
    for v, rh, rp in rules:
        if v and rh is not None:
            rh, rp = "".join(c.lower() if "A" <= c <= "Z" else c for c in rh), rp or ""
            if (host == rh or host.endswith("." + rh)) and path.startswith(rp):
                key = (len(rh + rp), len(rh), rh + rp)
                fits[key] = max(fits.get(key, v), v)
    if fits:
        best = max(fits)
        return host, path, best[2], fits[best]
    return host, path, None, "block" if set(host.replace("-", ".").split(".")) & set(words) else "allow"


@pytest.mark.parametrize(("bits", "most"), [(64, 10**6), (3, 10**6), (64, 0)])
def test_op13_brute_with_collisions_and_by_joins(spark, bits, most):
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    rows = spark.createDataFrame([(i, u, "other", 5) for i, u in enumerate([*URLS, *URLS[:6]])], "page_id long, url string, host string, rule long").repartition(3)
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(rows, rules, bits=bits, most=most).collect())
    assert got == [(i, *brute_verdict(u, RULES, url_filters.WORDS)) for i, u in enumerate([*URLS, *URLS[:6]])]
    assert {g[4] for g in got if g[3] is None} == {"allow", "block"}


def test_keys_are_sparks_own(spark):
    strings = ["", "a", "hexample.org", "ü" * 50]
    df = spark.createDataFrame([(s,) for s in strings], "s string").select(F.xxhash64("s"))
    assert [r[0] for r in df.collect()] == url_filters.hashed([s.encode() for s in strings], 64).view(np.int64).tolist()
