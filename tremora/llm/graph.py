"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.session import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the smallest node of its component as ``root``, for all nodes of ``edges``.

    ``edges`` has columns a and b; direction, repeats and self-loops do not matter, rows with
    a null do not count. Alternates large-star and small-star steps until the table no longer
    changes: each hangs neighbours under the smallest one, so the number of rounds grows with
    the logarithm of the longest path. Every step is written to the shared folder. Minima are
    pre-aggregated and stored before they are joined, so adaptive execution can split the
    rows of a node with very many neighbours.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(edges.distinct(), "edges")
    seen = None
    while True:
        edges = _star(edges, larger=True)
        edges = _star(edges, larger=False)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stored(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), "roots")


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (a, b) with a > b. Large: every larger neighbour of a node goes under the smallest
    node around it; small: the smaller ones do, and the node itself."""
    pairs = edges.select("a", "b")
    if larger:
        pairs = pairs.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = pairs.groupBy("a").agg(F.min("b").alias("least"))
    lowest = stored(lowest.select("a", F.least("a", "least").alias("least")), "lowest")
    joined = pairs.join(lowest, "a")
    if larger:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        own = lowest.select("a", F.col("least").alias("b"))
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(own)
    return stored(moved.where("a <> b").distinct(), "star")
