"""Comparison of crawls."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L


def _fields(old: DataFrame, new: DataFrame, tracked: list[str]) -> list[str]:
    return [f for f in tracked if f in old.columns and f in new.columns]


def _changed(f: str) -> Column:
    return F.col(f"n.{f}").isNotNull() & ~F.col(f"n.{f}").eqNullSafe(F.col(f"o.{f}"))


def recrawl_diff(old: DataFrame, new: DataFrame, tracked: list[str] | None = None, key: str = "platform_id", trigger: str = "input_duplicate") -> DataFrame:
    """One row per fetched record: status, changed fields, old and new values as text."""
    fields = _fields(old, new, tracked or L.VIDEO_TRACKED_FIELDS)
    j = new.alias("n").join(old.withColumn("_known", F.lit(True)).alias("o"), F.col(f"n.{key}") == F.col(f"o.{key}"), "left")
    known = F.col("o._known").isNotNull()
    entries = F.array_compact(F.array(*[F.when(known & _changed(f), F.struct(
        F.lit(f).alias("field"), F.col(f"o.{f}").cast("string").alias("old"), F.col(f"n.{f}").cast("string").alias("new"))) for f in fields]))
    out = j.select(F.col(f"n.{key}").alias(key), known.alias("_known"), entries.alias("delta"))
    changed = F.transform("delta", lambda d: d["field"])
    return out.select(
        key, F.lit(trigger).alias("trigger"), F.when(~F.col("_known"), "new").when(F.size("delta") > 0, "recrawled").otherwise("no_changes").alias("status"),
        changed.alias("fields_changed"), "delta", F.array_contains(changed, "title").alias("title_changed"), F.array_contains(changed, "description").alias("description_changed"))


def apply_recrawl(old: DataFrame, new: DataFrame, as_of: str, tracked: list[str] | None = None, key: str = "platform_id") -> DataFrame:
    """The stored table after the crawl.

    A changed record takes the new values, status ``reindexing`` and both times; an unchanged one only the crawl time; one
    that was not fetched stays as it is. New records are added as ``discovered``. All stored columns are kept.
    """
    fields = _fields(old, new, tracked or L.VIDEO_TRACKED_FIELDS)
    own = ("status", "last_crawled_at", "updated_at")
    n = new.withColumn("_seen", F.lit(True)).alias("n")
    j = old.withColumn("_known", F.lit(True)).alias("o").join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    any_change = F.lit(False)
    for f in fields:
        any_change = any_change | _changed(f)
    known, seen, now = F.col("o._known").isNotNull(), F.col("n._seen").isNotNull(), F.lit(as_of).cast("timestamp")
    touched = ~known | (seen & any_change)

    def stored(c, kind):
        return F.col(f"o.{c}").cast(kind) if c in old.columns else F.lit(None).cast(kind)

    def rest(c):
        return F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in new.columns else F.col(f"o.{c}")

    return j.select(
        F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[F.coalesce(f"n.{f}", f"o.{f}").alias(f) for f in fields],
        *[rest(c).alias(c) for c in old.columns if c not in (key, *fields, *own)],
        F.when(~known, "discovered").when(seen & any_change, "reindexing").otherwise(stored("status", "string")).alias("status"),
        F.when(seen, now).otherwise(stored("last_crawled_at", "timestamp")).alias("last_crawled_at"),
        F.when(touched, now).otherwise(stored("updated_at", "timestamp")).alias("updated_at"))


def recrawl_comments(old: DataFrame, new: DataFrame) -> DataFrame:
    """Comments added and deleted per video."""
    added = new.join(old.select("id"), "id", "left_anti").groupBy("video_id").agg(F.count(F.lit(1)).alias("comments_added"))
    gone = old.join(new.select("id"), "id", "left_anti").groupBy("video_id").agg(F.count(F.lit(1)).alias("comments_deleted"))
    return added.join(gone, "video_id", "full").fillna(0)


def recrawl_history(events: DataFrame, video_id=None, n: int = 50) -> DataFrame:
    if video_id is not None:
        events = events.filter(F.col("video_id") == video_id)
    return events.orderBy(F.desc("recrawled_at"), "id").limit(n)
