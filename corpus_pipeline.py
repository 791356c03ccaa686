"""Corpus pipeline: documents to packed training sequences, in five stages of the operators in lociframe.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.common import NO_ID, materialise
from lociframe.llm.jaccard_join import near_duplicates
from lociframe.llm.language_id import UNKNOWN, label_languages
from lociframe.llm.mixing import mixed_documents
from lociframe.llm.packing import pack, public_tokenizer
from lociframe.llm.substring_dedup import remove_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a missing lang becomes the predicted one. Null texts and texts without a
    letter go. Rows that share a doc_id are judged each."""
    rows, of = label_languages(docs)
    return rows.where(F.col(of)["lang_pred"] != UNKNOWN).withColumn("lang", F.coalesce("lang", F.col(of)["lang_pred"])).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, the one with the smallest doc_id, and all documents without words.
    Of rows equal in doc_id and text one stays."""
    found = near_duplicates(docs)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    kept = materialise(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key.alias("__kept")).distinct())
    # joined by one column without nulls, so that equal rows are in one partition already and no text moves twice
    rows = docs.withColumn("__k", key).join(kept, F.col("__k") == F.col("__kept"), "left_semi")
    return rows.dropDuplicates(["__k", "text"]).drop("__k")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that documents with smaller ids have; a text that loses nothing stays
    as it is, others get single spaces. A null text becomes empty. n_chars follows the text."""
    cut = remove_repeats(docs, carry=("lang", "source"), untouched=True)
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, repeats included, as its text; documents of which it takes nothing go."""
    return mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 ids."""
    return pack(docs, public_tokenizer("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("substring_dedup", substring_dedup), ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]

#: Suffix comparison, graph components and the tokenizer are beyond SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
