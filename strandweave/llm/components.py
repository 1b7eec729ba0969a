"""Connected components of an edge table by alternating large-star and small-star steps (no driver-side graph)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a vertex is linked to the least vertex of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Every vertex and its lower neighbours are linked to the least of them; edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    low = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b of one orderable type, a <> b) to (a, b): every vertex but the least of its component, with
    that least vertex. Repeated edges and both directions are welcome; an empty table gives an empty result."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        now = cut(small_star(large_star(now).filter("a <> b").distinct()).filter("a <> b").distinct())
        new = mark(now)
        if new == seen:
            break
        seen = new
    return now
