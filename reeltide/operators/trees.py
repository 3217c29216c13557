"""Parent links resolved with doubling joins: rounds grow with log2 of the depth, not with the depth."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def resolve_chains(nodes: DataFrame, key: str, parent: str, known: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(key, root, depth) of every node whose chain of parents ends in a root.

    ``known`` holds already resolved nodes as (key, root, depth). Nodes below a missing parent, in a cycle or
    deeper than ``max_depth`` are left out. Hot parents are left to the skew split of the join.
    """
    start = nodes.select(
        F.col(key).alias("key"), F.coalesce(F.col(parent), F.col(key)).alias("at"),
        F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("dist"), F.col(parent).isNull().alias("done"))
    if known is not None:
        start = start.unionByName(known.select(
            F.col(key).alias("key"), F.col("root").alias("at"), F.col("depth").cast("long").alias("dist"), F.lit(True).alias("done")))
    state = cut_lineage(start)
    for _ in range(32 if max_depth is None else max(max_depth, 1).bit_length() + 1):
        open_rows = state.filter(~F.col("done"))
        if open_rows.isEmpty():
            break
        target = state.select(F.col("key").alias("at"), F.col("at").alias("at2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"))
        moved = open_rows.join(target, "at").select(
            "key", F.col("at2").alias("at"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"))
        if max_depth is not None:
            moved = moved.filter(F.col("dist") <= max_depth)
        state = cut_lineage(state.filter("done").unionByName(moved))
    found = state.filter("done")
    if known is not None:
        found = found.join(known.select(F.col(key).alias("key")), "key", "left_anti")
    return found.select(F.col("key").alias(key), F.col("at").alias("root"), F.col("dist").alias("depth"))


def ancestor_closure(nodes: DataFrame, key: str = "id", parent: str = "parent_comment_id", max_distance: int | None = None) -> DataFrame:
    """(descendant, ancestor, distance): all ancestors of every node, or those within ``max_distance``.

    The number of nodes bounds the distance, so nodes in a cycle meet themselves rather than go on for ever.
    """
    if max_distance is None:
        max_distance = nodes.count()
    base = nodes.filter(F.col(parent).isNotNull()).join(
        nodes.select(F.col(key).alias(parent)), parent, "left_semi")
    closure = cut_lineage(base.select(
        F.col(key).alias("descendant"), F.col(parent).alias("ancestor"), F.lit(1).cast("long").alias("distance")))
    step = 1
    while step < max_distance:
        far = closure.filter(F.col("distance") == step)
        if far.isEmpty():
            break
        beyond = closure.select(
            F.col("descendant").alias("ancestor"), F.col("ancestor").alias("top"), F.col("distance").alias("more"))
        longer = far.join(beyond, "ancestor").select(
            "descendant", F.col("top").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        closure = cut_lineage(closure.unionByName(longer.filter(F.col("distance") <= max_distance)))
        step *= 2
    return closure
