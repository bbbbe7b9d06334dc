"""Connected components of links, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.shared import discard, stored


def _large_stars(edges: DataFrame) -> DataFrame:
    """Every edge (a, b), a < b, moved from a to the least node around a."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return edges.join(least, edges.a == least.node).select(F.col("least").alias("a"), "b").distinct()


def _small_stars(edges: DataFrame) -> DataFrame:
    """The lesser nodes around every b, and b itself, moved to the least of them."""
    least = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("least"))
    moved = edges.join(least, edges.b == least.node).where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("least").alias("a"), F.col("node").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); component is the least node reachable.

    Each round moves edges to lesser nodes, first those to greater and then
    those to lesser neighbours. Edges that meet become one, so their number
    never grows and soon is that of the nodes, however many links a group has.
    Rounds end when all edges lead to a node that leads nowhere, the least of its
    component. Edges are stored in the shared folder.
    """
    edges = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        # Of stars, each node is an end once or a centre.
        met = edges.select("b").union(edges.select("a").distinct()).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        if met.where("n > 1").isEmpty():
            break
        # Stored, as the second step reads the first one's edges more than once.
        moved = stored(_large_stars(edges), "moved")
        before, edges = edges, stored(_small_stars(moved), "edges")
        discard(before, moved)
    components = stored(edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct()), "components")
    discard(edges)
    return components
