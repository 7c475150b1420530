"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a grouping (the least neighbour of each node) and a join on the node, so nothing
is gathered by node; a node with very many links is split by the adaptive skew join.  Each step's
links are written to the shared folder, which keeps the plan short and outlives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.tables import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v).  Large: each node's greater neighbours are sent to its least one.  Small: its lesser ones and itself are."""
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u > v); the component is its least node."""
    edges = stored(edges.select("u", "v").where("u > v").distinct(), "cc")
    while True:
        before = edges
        edges = stored(_star(stored(_star(edges, True), "cc"), False), "cc")
        # done when every node has one link, to a node that has none itself: both steps then change nothing
        if edges.exceptAll(before).isEmpty() and before.exceptAll(edges).isEmpty():
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
