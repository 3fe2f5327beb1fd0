"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchline.sources.scratch import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Join each node's greater neighbours to the least node it knows."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Join each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (columns a, b); the component is the least node. Self-links and repeated links do no harm.

    Each step is written to the shared folder and works on link rows only; the number of steps grows with the logarithm of the longest chain.
    """
    edges = links.select("a", "b").where("a <> b").distinct()
    while True:
        edges = materialise(_small_star(_large_star(edges)), "links")
        # Done when each node has one edge and no edge ends at a node that has one itself.
        inner = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").agg(F.count(F.lit(1)).alias("inner"))
        n, nodes = edges.agg(F.count(F.lit(1)), F.countDistinct("a")).first()
        if n == nodes and not inner.first()[0]:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
