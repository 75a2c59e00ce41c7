"""Connected components of a graph of any size: alternating large and small stars, a table between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    own = least.select(F.col("m").alias("a"), "b")
    return joined.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node that has an edge and isn't its component's smallest. ``edges``: a < b, a table.

    Each round roughly halves the depth of every tree; it ends when a round changes nothing.
    """
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
    before = mark(edges)
    while True:
        edges = written(_small_star(_large_star(edges)), "stars")
        after = mark(edges)
        if after == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = after


def trees(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest given as (a, b): b's parent is a < b, and each b has one. Depths halve in each round."""
    labels = written(parents.select(F.col("b").alias("node"), F.col("a").alias("root"), F.lit(True).alias("moved")), "trees")
    while labels.where("moved").head(1):
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        joined = labels.select("node", "root").join(up, "root", "left")
        labels = written(joined.select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "trees")
    return labels.select("node", "root")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) after more links (a, b): only the graph of the components that these join is worked on."""
    if not links.head(1):
        return labels
    for side in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(side), F.col("root").alias("_r")), side, "left").withColumn(side, F.coalesce("_r", side)).drop("_r")
    joined = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "joined")
    tops = components(joined)
    moved = labels.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return written(moved.select("node", F.coalesce("top", "root").alias("root")).union(tops.select("node", "root")), "labels")
