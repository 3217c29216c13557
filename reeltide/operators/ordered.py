"""Order-dependent building blocks that do not put a whole key into one task.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task, which fails when one channel or video
holds a large share of the data. Here every key is cut into coarse order buckets (``bucket`` must grow with the
order): rows are windowed inside ``(key, bucket)``, one summary row per bucket carries the result across bucket
borders, and both sides are joined on the same partitioning, so no further shuffle of the rows is needed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import col


def time_bucket(seconds: Column | str, width: float) -> Column:
    return F.floor(col(seconds) / F.lit(float(width))).cast("long")


def _keys(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _neighbour(df, keys, order, bucket, fields, name, forward):
    keys = _keys(keys)
    rows = df.withColumn("_b", bucket)
    payload = F.struct(*[F.col(f) for f in fields])
    rank = F.struct(*[F.col(o) for o in order])
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    pick = F.min_by if forward else F.max_by
    edges = rows.groupBy(*keys, "_b").agg(pick(payload, rank).alias("_edge"))
    across = Window.partitionBy(*keys).orderBy("_b")
    step = F.lead if forward else F.lag
    edges = edges.select(*keys, "_b", step("_edge").over(across).alias("_beyond"))
    inside = rows.withColumn("_inside", step(payload).over(w))
    return (
        inside.join(edges, [*keys, "_b"], "left")
        .withColumn(name, F.coalesce("_inside", "_beyond"))
        .drop("_b", "_inside", "_beyond")
    )


def with_previous(df: DataFrame, keys, order: list[str], bucket: Column, fields: list[str], name: str = "prev") -> DataFrame:
    """Add struct ``name`` with the fields of the previous row of the key (null for the first)."""
    return _neighbour(df, keys, order, bucket, fields, name, forward=False)


def with_next(df: DataFrame, keys, order: list[str], bucket: Column, fields: list[str], name: str = "next") -> DataFrame:
    return _neighbour(df, keys, order, bucket, fields, name, forward=True)


def with_neighbours(df: DataFrame, keys, order: list[str], bucket: Column, fields: list[str], prev: str = "prev", next: str = "next") -> DataFrame:
    """Both neighbours in one pass."""
    keys = _keys(keys)
    rows = df.withColumn("_b", bucket)
    payload, rank = F.struct(*[F.col(f) for f in fields]), F.struct(*[F.col(o) for o in order])
    across, w = Window.partitionBy(*keys).orderBy("_b"), Window.partitionBy(*keys, "_b").orderBy(*order)
    edges = rows.groupBy(*keys, "_b").agg(F.min_by(payload, rank).alias("_first"), F.max_by(payload, rank).alias("_last"))
    edges = edges.select(*keys, "_b", F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"))
    inside = rows.withColumns({"_p": F.lag(payload).over(w), "_n": F.lead(payload).over(w)}).join(edges, [*keys, "_b"], "left")
    return inside.withColumns({prev: F.coalesce("_p", "_before"), next: F.coalesce("_n", "_after")}).drop("_b", "_p", "_n", "_before", "_after")


def with_position(df: DataFrame, keys, order: list[str], bucket: Column, pos: str = "pos", n: str = "n") -> DataFrame:
    """Add the 0-based position in the key and the size of the key."""
    keys = _keys(keys)
    rows = df.withColumn("_b", bucket)
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *keys, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias(n),
    )
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (
        rows.withColumn("_rn", F.row_number().over(w))
        .join(counts, [*keys, "_b"])
        .withColumn(pos, F.col("_before") + F.col("_rn") - 1)
        .drop("_b", "_rn", "_before")
    )


def with_running(df: DataFrame, keys, order: list[str], bucket: Column, value: Column, name: str, how: str = "sum",
                 inclusive: bool = True) -> DataFrame:
    """Running sum or max of ``value`` over the key, up to (or before) the current row."""
    keys = _keys(keys)
    fold = {"sum": F.sum, "max": F.max}[how]
    rows = df.withColumn("_b", bucket).withColumn("_v", value)
    parts = rows.groupBy(*keys, "_b").agg(fold("_v").alias("_p"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_b", fold("_p").over(before).alias("_before"))
    last = 0 if inclusive else -1
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    inside = rows.withColumn("_inside", fold("_v").over(w)).join(parts, [*keys, "_b"], "left")
    if how == "sum":
        out = F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0))
    else:
        out = F.greatest("_before", "_inside")
    return inside.withColumn(name, out).drop("_b", "_v", "_inside", "_before")


def with_island(df: DataFrame, keys, order: list[str], bucket: Column, starts: Column, name: str = "island") -> DataFrame:
    """Number the runs of consecutive rows; ``starts`` is true on the first row of a run."""
    return with_running(df, keys, order, bucket, F.when(starts, 1).otherwise(0), name)


def top_n_per_key(df: DataFrame, keys, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key. Spark puts a group limit below the shuffle, so a hot key sends at most n rows per task."""
    final = Window.partitionBy(*_keys(keys)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= n)


def _is_map(df: DataFrame, name: str) -> bool:
    return "map<" in df.schema[name].dataType.simpleString()


def exact_quantile(df: DataFrame, keys, value: str, p: float, name: str, bins: int = 512) -> DataFrame:
    """Exact linear-interpolated quantile per key without sorting a key in one task.

    Values are counted into ``bins`` equal ranges of the key; only the ranges that hold the two wanted ranks
    are counted by distinct value and accumulated.
    """
    keys = _keys(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    span = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("_n"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins).otherwise(0.0)
    # the values are the large side, whatever size the optimizer takes them for
    binned = rows.hint("merge").join(span, keys).withColumn("_bin", F.floor(width))
    counts = binned.groupBy(*keys, "_bin").agg(F.count("_v").alias("_c"), F.first("_n").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bin")
    rank_at = (F.col("_n") - 1) * F.lit(float(p))
    low, high = F.floor(rank_at), F.ceil(rank_at)
    counts = counts.withColumn("_end", F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))
    wanted = counts.filter((F.col("_end") > low) & (F.col("_start") <= high)).select(*keys, "_bin", "_start")
    values = binned.hint("merge").join(wanted, [*keys, "_bin"]).groupBy(*keys, "_bin", "_v").agg(
        F.count("_v").alias("_c"), F.first("_start").alias("_start"), F.first("_n").alias("_n"))
    within = Window.partitionBy(*keys, "_bin").orderBy("_v")
    values = values.withColumn("_end", F.col("_start") + F.sum("_c").over(within)).withColumn("_begin", F.col("_end") - F.col("_c"))
    holds_low = (F.col("_begin") <= low) & (F.col("_end") > low)
    holds_high = (F.col("_begin") <= high) & (F.col("_end") > high)
    picked = values.groupBy(*keys).agg(
        F.max(F.when(holds_low, F.col("_v"))).alias("_a"), F.max(F.when(holds_high, F.col("_v"))).alias("_z"),
        F.first(rank_at - low).alias("_f"))
    return picked.select(*keys, (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")).alias(name))
