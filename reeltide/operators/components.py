"""Connected components by star contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release


def _clean(edges: DataFrame) -> DataFrame:
    """Distinct edges (a, b) with a > b."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node move to the smallest node of its neighbourhood."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node and the node itself move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without an edge are left out.

    Large and small star steps in turn until nothing changes; the number of rounds grows with the logarithm of the longest
    path, whatever the diameter. Each step is cut by a checkpoint, moves no more rows than there are edges and nodes, and
    deletes what the step before it left.
    """
    now = cut_lineage(_clean(edges.toDF("a", "b")))
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = tuple(seen)
        for star in (_large_star, _small_star):
            before, now = now, cut_lineage(_clean(star(now)))
            release(before)
