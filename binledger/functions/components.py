"""Connected components of an edge table, as rounds of joins.

Union by smallest label with path shortening: every round links each node to the
smallest node around it (large star, then small star), which keeps all components and
at least halves long paths. No component is ever gathered in one place; every round's edges are
written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binledger.session import cut


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge to a node that none leads from."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    sums = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return sums.where("out > 1 OR (out = 1 AND into > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the smallest node reached.

    Repeated edges, loops and edges with a null end are harmless; no edges give no rows.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # every edge points down by now
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct(), "small-star")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
