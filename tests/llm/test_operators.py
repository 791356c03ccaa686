"""The training-data operators against brute force and on awkward rows: nulls, empty and long texts, ties, clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lociframe.llm import fingerprints, html_extraction, jaccard_join, language_id, license_scan, mixing, packing, quality_rules, substring_dedup, suffix_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, n long, c long, label string, row long"


def rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6)))
    base = " ".join(word() for _ in range(120))
    passage = " ".join(word() for _ in range(60))
    texts = [base, base, base.replace(" ", "  ", 3), base.upper(), passage, passage + " " + base, f"{base}\n{passage}", "x " * 400, " ".join(word() for _ in range(5000)), "", None, " \t\n", "one", "one", "two words", "12 34", "日本語 テキスト 日本語 テキスト"]
    edited = base.split()
    for i in range(6):
        e = list(edited)
        e[10 * i + 3] = "EDIT"
        texts.append(" ".join(e))
    out = [(i * 3 % 29, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", None, "x", i, None, "y", 1) for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in rows()]


def test_op8_brute(spark, docs, pairs):
    got = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256))
    assert sorted(map(tuple, got.collect())) == brute.words_removed(pairs)


def test_op5_brute(spark, docs, pairs):
    got = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect())) == brute.bytes_removed(pairs)


def test_op6_brute(spark, docs, pairs):
    assert sorted(map(tuple, jaccard_join.near_duplicates(docs).collect())) == brute.jaccard_components(pairs)


@pytest.mark.parametrize("name", ["op5", "op6", "op8"])
def test_brute_on_given_table(spark, name):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [tuple(r) for r in table.select("doc_id", "text").collect()]
    run, want = {"op5": (suffix_dedup.op5_suffix_dedup, brute.bytes_removed), "op6": (jaccard_join.op6_jaccard_join, brute.jaccard_components), "op8": (substring_dedup.op8_substring_dedup, brute.words_removed)}[name]
    want = want(docs)
    assert sorted(tuple(r)[: len(want[0])] for r in run(spark, SF).collect()) == want


def test_same_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {(None, 0), (1, 80), (2, 0)}
    got = sorted(((r.doc_id or -1, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect()))
    n = len(text)
    assert got == [(-1, 0, 0), (1, n, 1), (1, n, 1), (2, 0, 0)]
    only = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.remove_repeats(only).collect()] == [0, 0]


@pytest.mark.parametrize("f", [substring_dedup.remove_repeats, suffix_dedup.remove_repeats, jaccard_join.near_duplicates, fingerprints.edited_fingerprints, quality_rules.ledger, mixing.mix, mixing.mixed_documents, license_scan.scan_licenses, language_id.identify, lambda d: packing.pack(d, packing.public_tokenizer("word_bpe_49k.json"))])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deep_shallow_sort():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 99, 4000).astype(np.uint8)
    raw[1000:1600], raw[3000:3400] = raw[100:700], raw[150:550]
    starts = np.sort(rng.choice(3900, 1500, replace=False))
    order, equal = suffix_dedup.deep_shallow_sort(raw, starts, 100)
    cut = [raw[starts[i] : starts[i] + 100].tobytes() for i in order]
    assert cut == sorted(cut)
    assert equal.tolist() == [i > 0 and cut[i] == cut[i - 1] for i in range(len(cut))]


def test_signatures_are_complete():
    """Linked sets share a signature, whatever tokens are frequent and in all size levels."""
    rng = np.random.default_rng(5)
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 10, 12, 15, 16, 21, 31, 40, 64, 100]:
        for _ in range(60):
            x = rng.integers(0, 2**64, n, dtype=np.uint64)
            counts = rng.integers(0, 3, jaccard_join.CELLS).astype(np.int64)
            drop = rng.integers(0, n - math.ceil(0.75 * n) + 1)
            y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 2**64, rng.integers(0, 1 + n // 4), dtype=np.uint64)]))
            x = np.unique(x)
            both = len(np.intersect1d(x, y))
            if 100 * both >= 75 * (len(x) + len(y) - both):
                a, b = (np.concatenate(jaccard_join.signatures(s, counts, 1)) for s in (x, y))
                assert len(np.intersect1d(a, b))


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120)).astype(np.uint64)) for _ in range(80)]
    got = jaccard_join.shared_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(80) for j in range(80) if i != j)


def test_op1(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_tokenizer("word_bpe_49k.json"))
    odd = ["it's I've 'S ’s don''t", "İstanbul ΑΣ é é", "a b c\u0085d", "123 4a５ <|endoftext|> <|ENDOFTEXT|>", "a—, x,—y ÀÉ×÷ Ñ.ñ?!", "", "  "]
    tokenizer = packing.WordTokenizer(packing.public_tokenizer("word_bpe_49k.json"))
    assert [ids.tolist() for _, ids in tokenizer(pa.array(odd))] == [t.encode(x, add_special_tokens=False).ids for x in odd]
    got = packing.pack(docs, packing.public_tokenizer("word_bpe_49k.json")).collect()
    want = Counter()
    for d, text, *_ in rows():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 2048):
            own = np.array(ids[p : p + 2048], "<u4")
            want[d, p // 2048, p, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in map(sorted, seqs.values()):
        assert s[0][0] == 0 and sum(x[1] for x in s) <= 2048 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:], strict=False))
    assert len(seqs) <= -(-sum(r.length for r in got) // 2048) + 1


def test_op2():
    page = """<html><head><title>t</title></head><body><header>Site</header><nav><a>m</a></nav><div class="cookie-notice">c</div><article><h1>A&amp;B &copy</h1><p>One <b>tw</b>o<br>three<p>four<form>f</form>
    <script>var x="</p>";</script><div id="comments">r</div></article><aside>s</aside><footer>z</footer>"""
    assert html_extraction.main_text(html_extraction.parse(page), set()) == "A&B © One two three four"
    assert html_extraction.main_text(html_extraction.parse("plain <b>text"), set()) == "plain text"
    a, b = (html_extraction.parse(f"<body><div>{x}<p>Share this</p></div></body>") for x in ("<p>one</p>", "<p>other</p><ul><li>x</ul>"))
    pairs = {(p.tag, q.tag) for p, q in html_extraction.aligned(a, b)}
    assert ("p", "p") in pairs and html_extraction.tree_match(a, b, {}) >= 4
    assert html_extraction.parse("<div>" * 5000 + "x").tag == "#root"


def test_op2_template(spark):
    pages = [(i, "http://h.example/x", f"<body><div><p>Story {i} text</p><p>Print this page</p></div></body>") for i in range(6)] + [(90, None, None), (91, "http://o.example/", "")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == ("Story 3 text", 12) and got[90] == ("", 0) == got[91]


def test_op3(spark, docs):
    for r in quality_rules.ledger(docs.where("text is not null").withColumn("text", F.col("text"))).join(docs.select("doc_id", "text"), "doc_id").collect():
        w = brute.WORD.findall(r.text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + d for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for d in range(3)}
        seen, dup = set(), 0
        for line in r.text.split("\n"):
            if brute.WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text)), dup, len(covered))


def test_op3_keeps_clean(spark):
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_rules.op3_quality_rules(spark, SF).join(lab, "doc_id").where("not base_failed")
    assert got.where("quality = 1 and not kept").count() == 0 and got.where("quality = 0 and kept").count() == 0
    book = quality_rules.ledger(spark.read.parquet(f"{SF}/documents.parquet"))
    for r in quality_rules.ablations(book, "v1").collect():
        bit = 1 << [n for n, _ in quality_rules.rules()].index(r.rule)
        assert r.n_failed == book.where(F.col("failed").bitwiseAND(F.lit(bit)) != 0).count() >= r.n_alone


def test_op4(spark, docs):
    got = language_id.op4_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.98
    assert got.where("score < 0 or score > 1").count() == 0
    odd = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert [odd[i * 3 % 29] for i in (9, 10, 11, 15)] == ["und"] * 4


def test_op7(spark, docs):
    import hashlib

    got = fingerprints.edited_fingerprints(docs).collect()
    texts = {d: t or "" for d, t, *_ in rows()}
    ids = sorted(texts, reverse=True)
    nxt = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    for r in got:
        t = texts[r.doc_id]
        h = len(t) // 2
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - h] + texts[nxt[r.doc_id]][:h]).encode()).hexdigest() and r.n_chars == len(t)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {}
    for r in got:
        prints.setdefault(tuple(sorted(texts[r.doc_id].split("\n"))), set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len(set.union(*prints.values())) == len(prints)
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(1, "a b\nc d")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_op7_is_homomorphic(spark):
    df = spark.createDataFrame([(0, "a b c\nd e"), (1, "a b c"), (2, "d e"), (3, "d e\na b c")], "id int, t string")
    f = {r.id: r for r in fingerprints.fingerprints(df, "t", "id").collect()}
    assert f[0].exact == f[3].exact and f[0].near == f[3].near
    both = fingerprints.fingerprints(df, "t", "id").where("id in (1, 2)").groupBy().agg(*(F.max(F.when(F.col("id") == i, F.struct("exact", "near"))).alias(f"f{i}") for i in (1, 2)))
    s = both.select(fingerprints.combined(F.col("f1"), F.col("f2")).alias("s")).first()["s"]
    assert s["exact"] == f[0].exact and s["near"] == f[0].near


def test_op9(spark, docs):
    got = mixing.mix(docs, block=8).collect()
    assert all(r.taken <= 3 * r.size for r in got)
    again = mixing.mix(docs.repartition(2), block=8)
    assert Counter((r.source_size, r.taken) for r in got).keys() == Counter((r.source_size, r.taken) for r in again.collect()).keys()
    per = {}
    for r in got:
        per.setdefault((r.source_size, r.target), []).append(r.taken)
    assert abs(sum(t for _, t in per) - sum(r.size for r in got)) < 1e-6 * sum(r.size for r in got) + 1
    for (size, target), taken in per.items():
        assert target <= 3 * size + 1e-6 and abs(sum(taken) - target) <= 0.05 * target + 16
    texts = mixing.mixed_documents(docs, block=8)
    words = {}
    for r in texts.select("doc_id", "text").collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(brute.WORD.findall(r.text))
    assert sum(words.values()) == sum(r.taken for r in got)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, None: 5}, {"a": 0, "b": 7}, {"a": 1, "b": 1, "c": 1000, "d": 3}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, want, free = sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            want |= share
            break
        want |= {s: 3 * sizes[s] for s in over}
        free -= over
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, total) for s in order)


def test_permutation(spark):
    for n in (1, 2, 3, 10, 257, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(4))).collect()
        assert sorted(r[0] for r in got) == list(range(n))


def test_op10(spark):
    apache = license_scan.TEMPLATES["apache-2.0-notice"]
    mit = license_scan.TEMPLATES["mit"]
    texts = [f"intro\n// {apache}\ncode", mit.replace("copies", "copys", 1), "All rights reserved. And much more text follows on this very line, which is no licence at all.", None, "", "Licenced under the MIT licence!", mit + "\n" + "All rights reserved."]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(7)] == [["apache-2.0-notice"], ["mit"], [], [], [], ["mit-short"], ["all-rights-reserved", "mit"]]
    assert got[0].best_dice == 1.0 and got[3].best_license is None
    # brute force: every stretch of lines against every template
    scan = license_scan.Scanner(license_scan.TEMPLATES, license_scan.THRESHOLD)
    lines = texts[6].split("\n")
    best = max(license_scan.dice(license_scan.bigrams([w for x in lines[i:j] for w in license_scan.normalised(x)]), license_scan.bigrams(license_scan.normalised(mit))) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1))
    assert max(d for name, d, *_ in scan(texts[6]) if name == "mit") == round(best, 6)
