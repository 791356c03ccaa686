"""Letters of all scripts in the quality rules; columns of documents that have the names of results."""

import pytest
from pyspark.sql import functions as F

from lociframe.llm import language_id, quality_rules


@pytest.mark.parametrize("word, letters, capitals, unspaced", [("Привет", 6, 1, 0), ("Ωμέγα", 5, 1, 0), ("日本語文章", 5, 0, 5), ("שלום", 4, 0, 0), ("naïve×", 5, 0, 0)])
def test_letters_of_all_scripts(spark, word, letters, capitals, unspaced):
    text = " ".join(f"{word}{'abcdefgh'[i % 8]}{'abcdefgh'[i // 8]}" for i in range(60))
    r = quality_rules.ledger(spark.createDataFrame([(1, text), (2, "ascii only")], "doc_id long, text string")).where("doc_id = 1").first()
    assert (r.n_letters, r.n_capitals, r.n_unspaced, r.failed) == (60 * (letters + 2), 60 * capitals, 60 * unspaced, 0)


def test_long_words_spare_scripts_without_spaces(spark):
    rng = "的一是在不了有和人这中大为上个国我以要他"
    text = " ".join(rng[i % 20 :] + rng[: i % 20] + chr(0x4E00 + i) for i in range(60))
    assert quality_rules.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(quality_rules.passes("v1")).first()[0]
    assert not quality_rules.ledger(spark.createDataFrame([(1, text.translate({ord(x): "x" for x in rng}))], "doc_id long, text string")).select(quality_rules.passes("v1")).first()[0]


def test_columns_named_like_results(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de", 7, "x", True, 1) for i in range(40)], "doc_id long, text string, lang string, score int, lang_pred string, held_out boolean, language int")
    rows, of = language_id.label_languages(docs)
    assert of not in docs.columns and rows.columns == [*docs.columns, of]
    assert rows.where(F.col(of)["lang_pred"] != F.col("lang")).count() == 0 == rows.where("score <> 7 or lang_pred <> 'x' or not held_out or language <> 1").count()
    assert language_id.identify(docs).columns == ["doc_id", "held_out", "lang_pred", "score"]
