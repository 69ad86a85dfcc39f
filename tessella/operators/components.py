"""Connected components of links inside parts of a table, by contraction.

Each round every node points to the least of its neighbours and itself, pointers
are followed to their ends by doubling, and links between what they end in make
the next round's smaller table; the components are found when no links are left.
Nothing gathers a component: nodes join on (part, node), and one row stands for
each end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.shared import written


def _followed(pointers: DataFrame) -> DataFrame:
    """Pointers ``(part, node, up)`` replaced by where they end."""
    while True:
        next_ = pointers.select("part", F.col("node").alias("up"), F.col("up").alias("beyond"))
        longer = written(pointers.join(next_, ["part", "up"], "left").select("part", "node", F.coalesce("beyond", "up").alias("up"), (F.coalesce("beyond", "up") != F.col("up")).alias("moved")), "pointers")
        pointers = longer.drop("moved")
        if longer.where("moved").isEmpty():
            return pointers


def connected(links: DataFrame) -> DataFrame:
    """``links(part, a, b)`` to ``(part, node, label)``: each node of a link and its component's least node."""
    links = written(links.where("a <> b").select("part", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    nodes = links.select("part", F.col("a").alias("node")).union(links.select("part", F.col("b").alias("node"))).distinct()
    found = written(nodes.withColumn("label", F.col("node")), "labels")
    while not links.isEmpty():
        both = links.select("part", F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("part", F.col("b").alias("node"), F.col("a").alias("other")))
        nearest = both.groupBy("part", "node").agg(F.min("other").alias("other")).select("part", "node", F.least("node", "other").alias("up"))
        ends = _followed(written(nearest, "nearest"))
        found = written(found.join(ends.withColumnRenamed("node", "label"), ["part", "label"], "left").select("part", "node", F.coalesce("up", "label").alias("label")), "labels")
        for side in ("a", "b"):
            links = links.join(ends.withColumnRenamed("node", side), ["part", side]).drop(side).withColumnRenamed("up", side)
        links = written(links.where("a <> b").select("part", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    return found
