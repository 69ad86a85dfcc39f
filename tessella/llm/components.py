"""Connected components of an edge table by alternating large-star and small-star steps.

All state stays in DataFrames.  A step groups edges by a vertex with a partial
minimum first, so a hub with a large part of all edges sends few rows; the
joins that follow leave hubs to Spark's skew-join splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(low.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(u, v)`` edges to ``(node, label)``: every vertex with an edge to another, and its component's smallest vertex.

    Nulls, loops and repeated edges are ignored; no edges give no rows.
    """
    now = scratch.cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    size = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
    while True:
        after = scratch.cut(_small_star(_large_star(now).distinct()).distinct(), "edges")
        was, size = size, after.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        scratch.drop(now)
        now = after
        if was == size:
            break
    ends = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(ends)
