"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (itself included)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b"), F.col("m").alias("a"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(low, "a").where("b != m").select("b", F.col("m").alias("a")).union(low.select(F.col("a").alias("b"), F.col("m").alias("a")))


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of long ids -> (node, component): every linked node with the smallest id of its component.

    Each round is two grouped minimums and two joins on the node; a hub only has
    a running minimum and its rows may be split, so no group is gathered. The
    rounds needed grow with the logarithm of a component's size. The edges are
    cut to the shared folder each round; rounds end when the edges stay as they are.
    """
    edges = cut(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        large = _large_star(edges).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
        edges = cut(_small_star(large).select("a", "b").where("a != b").distinct())
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
