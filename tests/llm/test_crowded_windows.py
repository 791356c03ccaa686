"""Windows that one document holds many times still meet those of other tasks."""

import brute
import pytest
from pyspark.sql import functions as F

from lociframe.llm import substring_dedup


@pytest.fixture
def apart(spark):
    """Makes a DataFrame with each row in a partition of its own, and keeps small partitions apart after shuffles too."""
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield lambda rows: spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    for c, v in old.items():
        spark.conf.set(c, v)


def test_op8_crowded_windows(apart):
    pairs = [(1, "x " * 400), (2, "x " * 400), (3, "a b c " + "x " * 50 + "d e"), (4, "x y " * 200), (5, "x y " * 200), (6, "q " + "x y " * 26)]
    got = substring_dedup.remove_repeats(apart(pairs)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256))
    assert sorted(map(tuple, got.collect())) == brute.words_removed(pairs)
