"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import done_with, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a > b). Large star: a node's larger neighbours move to the least of it and its neighbours; small star: it and its smaller neighbours do."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); a component is named by its least node.

    Ends when each edge joins a node with its component's least node; the steps grow with the logarithm of the longest path.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    while True:
        before, e = e, materialize(_stars(_stars(e, True), False), "stars")
        done_with(before)
        # a star forest: no node has two edges up, and no target has an edge of its own
        split = e.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        if split and e.select(F.col("b").alias("a")).join(e.select("a"), "a", "left_semi").isEmpty():
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
