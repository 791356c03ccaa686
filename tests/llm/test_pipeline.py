"""Each stage of the pipeline against brute force on its own input."""

import brute

import corpus_pipeline as pipeline
from lociframe.llm.common import materialise

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    states = [docs]
    for _, stage in pipeline.STAGES:
        states.append(materialise(stage(spark, states[-1], SF)))
    assert [s.columns for s in states[:-1]] == [COLUMNS] * 5
    texts = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in states[:-1]]

    def has_letter(t):
        return any(c.isalpha() for c in t or "")

    assert texts[1] == {k: t for k, t in texts[0].items() if has_letter(t)}
    groups = brute.jaccard_components(texts[1].items())
    assert set(texts[2]) == {k for k, _, c in groups if k == c} and all(texts[2][k] == texts[1][k] for k in texts[2])
    want = {r[0]: r for r in brute.words_removed(texts[2].items())}
    assert set(texts[3]) == set(texts[2])
    for k, t in texts[3].items():
        words = brute.WORD.findall(t)
        assert brute.sha(" ".join(words).encode()) == want[k][3] and (want[k][2] or t == texts[2][k])
    size = {k: len(brute.WORD.findall(t)) for k, t in texts[3].items()}
    taken = {k: len(brute.WORD.findall(t)) for k, t in texts[4].items()}
    assert all(0 < taken[k] <= 3 * size[k] for k in taken) and abs(sum(taken.values()) - sum(size.values())) < 0.02 * sum(size.values()) + 200
    for k, t in texts[4].items():
        assert t == texts[3][k] or set(brute.WORD.findall(t)) <= set(brute.WORD.findall(texts[3][k]))
    pieces = states[5].collect()
    assert {r.doc_id for r in pieces} == set(texts[4])
    assert len({r.sequence_id for r in pieces}) <= -(-sum(r.length for r in pieces) // 2048) + 1


def test_awkward_rows(spark):
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (2, "Hello world, this is text", None, None, 1), (2, "Hello world, this is text", "en", "a", 1), (3, "12 34", "en", "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF))
    assert {r.doc_id for r in docs.collect()} == set() or {r.doc_id for r in docs.collect()} == {2}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
