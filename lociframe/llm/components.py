"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b).

    Large-star and small-star rounds alternate: every node is linked to the smallest of its neighbours, so that a node's
    rows never exceed its edges and the number of rounds grows with the logarithm of a component's diameter.
    """
    old, state = [], None
    links = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), old)
    while True:
        # large star: neighbours above u, and u's least neighbour
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        links = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u's neighbours below it are linked to the least of them
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        made: list[str] = []
        links = materialise(links.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), made)
        discard(links.sparkSession, old)
        old = made
        now = links.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if state == now:
            break
        state = now
    out = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return out.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
