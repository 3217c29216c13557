"""Structured Streaming: comment intake, running counts, event rates, joins of streams."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.numbers import rnd
from ..operators.comments import nlp_annotate
from ..operators.recrawl import recrawl_diff
from ..session import staging_path


# ---- pipelines ---------------------------------------------------------------------------

def comment_stream(source: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Comments with late repeats of a key dropped inside the watermark."""
    return source.withWatermark("timestamp_posted", delay).dropDuplicatesWithinWatermark(["platform_comment_id"])


def annotate_stream(comments: DataFrame, **thresholds) -> DataFrame:
    """Stateless annotation of every new comment."""
    return nlp_annotate(comments, **thresholds)


def event_rate(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 minute", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, delay).groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n")


def metric_stream(points: DataFrame, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    return points.withWatermark("timestamp", delay).groupBy(F.window("timestamp", window).alias("w"), "source").agg(
        F.count(F.lit(1)).alias("count"), rnd(F.avg("value"), 4).alias("average")).select(F.col("w.start").alias("bucket"), "source", "count", "average")


def author_state(comments: DataFrame) -> DataFrame:
    """Running count, first and last sighting per author (update mode)."""
    return comments.groupBy("author_id").agg(F.count(F.lit(1)).alias("comment_count"), F.min("timestamp_posted").alias("first_seen_at"), F.max("timestamp_posted").alias("last_seen_at"))


def edge_counter(edges: DataFrame) -> DataFrame:
    """Running count per source, target and type (update mode)."""
    return edges.groupBy("source", "target", "edge_type").agg(F.count(F.lit(1)).alias("count"))


def interval_join(comments: DataFrame, uploads: DataFrame, days: int = 7, delay: str = "1 day") -> DataFrame:
    """Comments within ``days`` after the upload of their video, both sides as streams."""
    c = comments.withWatermark("timestamp_posted", delay)
    u = uploads.select(F.col("video_id").alias("up_video"), "uploaded_at").withWatermark("uploaded_at", delay)
    near = (F.col("video_id") == F.col("up_video")) & (F.col("timestamp_posted") >= F.col("uploaded_at")) & (F.col("timestamp_posted") <= F.col("uploaded_at") + F.expr(f"interval {days} days"))
    return c.join(u, near).drop("up_video")


def graph_events(comments: DataFrame) -> DataFrame:
    """Graph mutations of new comments: one node event each, and a link event for a reply."""
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    node = F.struct(F.lit("COMMENT_ADDED").alias("event_type"), F.lit("Comment").alias("node_type"), text("id").alias("node_id"), none.alias("edge_type"), none.alias("source_id"), none.alias("target_id"))
    link = F.when(F.col("parent_comment_id").isNotNull(), F.struct(
        F.lit("COMMENT_LINKED").alias("event_type"), none.alias("node_type"), none.alias("node_id"), F.lit("REPLIES_TO").alias("edge_type"), text("id").alias("source_id"), text("parent_comment_id").alias("target_id")))
    return comments.select(F.col("timestamp_posted").alias("timestamp"), F.explode(F.array_compact(F.array(node, link))).alias("e")).select("timestamp", "e.*")


def replay(log: DataFrame, since: str | None = None, types: list[str] | None = None, limit: int = 500) -> DataFrame:
    """The last events at or after a time, oldest first."""
    unknown = set(types or []) - set(L.GRAPH_EVENT_TYPES)
    if unknown:
        raise ValueError(f"unknown event types {sorted(unknown)}")
    if since:
        log = log.filter(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if types:
        log = log.filter(F.col("event_type").isin(types))
    tie = ["event_type", F.coalesce("node_id", "source_id")]
    return log.orderBy(F.desc("timestamp"), *tie).limit(limit).orderBy("timestamp", *tie)


# ---- sinks -------------------------------------------------------------------------------

def append_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", interval: str | None = None):
    """Append to a Parquet table; without an interval all available data is processed once."""
    w = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path)
    return w.trigger(processingTime=interval).start() if interval else w.trigger(availableNow=True).start()


def upsert_to(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None, each: Callable[[DataFrame], DataFrame] | None = None, mode: str = "update"):
    """Changed rows of every micro batch under ``batch=<id>``. A replayed batch overwrites its own folder only."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if each is None else each(batch)
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return w.trigger(processingTime=interval).start() if interval else w.trigger(availableNow=True).start()


def latest_state(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Last written row of every key of an upsert sink."""
    t = spark.read.parquet(path)
    fields = [c for c in t.columns if c not in [*keys, "batch"]]
    return t.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("r")).select(*keys, "r.*")


def stream_recrawl(snapshots: DataFrame, stored: DataFrame, path: str, checkpoint: str, interval: str | None = None):
    """Compare every arriving batch of snapshots with the stored table."""
    return upsert_to(snapshots, path, checkpoint, interval, lambda b: recrawl_diff(stored, b), mode="append")


def drain(spark: SparkSession, start: Callable[[str, str], object], name: str) -> str:
    """Run a query over all available data into the shared folder; gives the output path."""
    base = staging_path(spark, name)
    q = start(f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return f"{base}/out"
