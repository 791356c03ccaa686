"""Counts over a stream of variants or events: an addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Rows per window of time and keys; rows later than `late` are dropped, which bounds the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), *keys, "n")
