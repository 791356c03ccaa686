"""Texts made to collide under polynomial hashes, and sizes beyond what a packed key or a sum once held."""

import brute
import pytest
from pyspark.sql import functions as F

from lociframe.llm import common, fingerprints, jaccard_join, language_id, packing, quality_rules, substring_dedup, suffix_dedup


def thue_morse(n, a="a", b="b"):
    """A text and its complement: they collide under every polynomial modulo 2^64 from 1024 symbols on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").repartition(2)


@pytest.mark.parametrize("n", [1024, 4096])
def test_long_words_and_lines(spark, n):
    x, y = thue_morse(n)
    passage = " ".join(f"w{i}" for i in range(49))
    texts = [x, y, f"{x} {passage}", f"{y} {passage}", f"{x}\n{y}\n{x} a b c", f"{x.upper()} q", f"{x} q"]
    docs = docs_of(spark, texts)
    pairs = list(enumerate(texts, 1))
    assert sorted(map(tuple, jaccard_join.near_duplicates(docs).collect())) == brute.jaccard_components(pairs)
    got = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256))
    assert sorted(map(tuple, got.collect())) == brute.words_removed(pairs)
    got = suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect())) == brute.bytes_removed(pairs)
    lines = docs_of(spark, [f"{x}\n{y}", f"{x}\n{x}\n{y}"])
    assert {r.doc_id: r.n_dup_lines for r in quality_rules.ledger(lines).collect()} == {1: 0, 2: 1}
    repeats = docs_of(spark, [f"{x} m n {y} m n", f"{x} m n {x} m n"])
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.ledger(repeats).collect()} == {1: 0, 2: 6}


@pytest.mark.parametrize("n", [1024, 4096])
def test_known_units_of_packing(spark, n):
    x, y = thue_morse(n)
    path = packing.public_tokenizer("word_bpe_49k.json")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    rows = packing.pack(docs_of(spark, [f"{x} {y}", y, x]), path).collect()
    sizes = {}
    for r in rows:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    crcs = {r.doc_id: r.ids_crc32 for r in rows if sizes[r.doc_id] == r.length}
    import zlib

    import numpy as np

    for i, t in enumerate([f"{x} {y}", y, x], 1):
        ids = [*own.encode(t, add_special_tokens=False).ids, 0]
        assert sizes[i] == len(ids)
        if i in crcs:
            assert crcs[i] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_hashes_depend_on_bytes_alone():
    texts = [b"", b"a", b"a\0", b"\0", b"abcdefgh", b"abcdefgh\0", b"abcdefghi", b"x" * 64, b"x" * 65, b"x" * 66, "é".encode()]
    import numpy as np

    both = []
    for order in (texts, texts[::-1]):
        raw = np.frombuffer(b"".join(order), np.uint8)
        ends = np.cumsum([len(t) for t in order])
        h = common.span_hashes(raw, ends - [len(t) for t in order], ends)
        both.append(dict(zip(order, h.tolist(), strict=True)))
    assert both[0] == both[1] and len(set(both[0].values())) == len(texts)
    a = common.word_hashes(np.frombuffer(b"AbZ", np.uint8), np.array([0]), np.array([3]), fold=True)
    assert a == common.word_hashes(np.frombuffer(b"abz", np.uint8), np.array([0]), np.array([3]))


def test_many_unshared_tokens(spark):
    """A set of over 524,288 tokens of its own, which shares one signature with another: keys must hold its size."""
    long = " ".join(str(i) for i in range(2_300_000))
    docs = docs_of(spark, [long, "1 2 3 4 5 6 7 8", "1 2 3 4 5 6 7 8 9", long + " end"])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == {1: (2_299_996, 1), 2: (4, 2), 3: (5, 2), 4: (2_299_997, 1)}


def test_sums_of_lanes_fit_the_longest_text():
    lines = 2**31  # a text has fewer bytes
    assert lines * (2**fingerprints.EXACT_BITS - 1) < 2**63


def test_many_lines(spark):
    df = spark.createDataFrame([(1, "a\n" * 400_000), (2, "a\n" * 399_999 + "b\n")], "doc_id long, text string")
    got = [tuple(r.exact) for r in fingerprints.fingerprints(df, "text", "doc_id").orderBy("doc_id").collect()]
    assert got[0] != got[1] and all(0 <= x < 2**32 for r in got for x in r)
    one = fingerprints.fingerprints(spark.createDataFrame([(1, "a"), (2, "")], "doc_id long, text string"), "text", "doc_id").orderBy("doc_id").collect()
    assert got[0] == tuple((400_000 * a + b) % 2**32 for a, b in zip(one[0].exact, one[1].exact, strict=True))


def test_deletion_undoes_insertion(spark):
    df = spark.createDataFrame([(1, "a b c d\ne f g\nh"), (2, "e f g"), (3, "h\na b c d")], "doc_id long, text string")
    p = {i: fingerprints.fingerprints(df.where(f"doc_id = {i}"), "text", "doc_id").select(F.struct("exact", "near").alias(f"p{i}")) for i in (1, 2, 3)}
    r = p[1].crossJoin(p[2]).crossJoin(p[3]).select(fingerprints.combined(F.col("p1"), F.col("p2"), -1).alias("x"), "p1", "p3", fingerprints.combined(F.col("p3"), F.col("p2")).alias("y")).first()
    assert r.x == r.p3 and r.y == r.p1


def test_a_language_of_one_repeated_text_is_learned(spark):
    rows = [(i, "der hund und die katze sind im garten", "de") for i in range(1, 301)] + [(i, f"the dog number {i} and the cat are in the garden", "en") for i in range(301, 601)]
    docs = spark.createDataFrame(rows, "k long, text string, lang string").repartition(3)
    assert set(language_id.learn(docs, sample=30)) == {"de", "en"}
