"""Band, overlap, nearest and lookup joins.

All of them join on the video and a time cell, so one long or popular video spreads over many tasks and never
pairs all its rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import col
from .ordered import time_bucket


#: Join hint of a side that was exploded into buckets. The optimizer takes it for as small as the rows it came from and would broadcast it.
DENSE = "merge"


def cells(start: Column | str, end: Column | str, width: float) -> Column:
    """Time cells touched by an interval; an inverted interval touches its start cell only."""
    lo = time_bucket(start, width)
    return F.explode(F.sequence(lo, F.greatest(lo, time_bucket(end, width))))


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs with start <= at <= end. Points lie in one cell, so no pair comes twice."""
    left = points.withColumn("_cell", time_bucket(at, width))
    right = intervals.withColumn("_cell", cells(start, end, width))
    return left.join(right, [key, "_cell"]).filter((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))).drop("_cell")


def overlapping(a: DataFrame, b: DataFrame, key: str, a_span: tuple[str, str], b_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs with b.start < a.end and b.end > a.start, each once: only in the later of the two first cells."""
    left = a.withColumn("_cell", cells(*a_span, width))
    right = b.withColumn("_cell", cells(*b_span, width))
    first = F.greatest(time_bucket(a_span[0], width), time_bucket(b_span[0], width))
    return left.join(right, [key, "_cell"]).filter(
        (F.col("_cell") == first) & (F.col(b_span[0]) < F.col(a_span[1])) & (F.col(b_span[1]) > F.col(a_span[0]))).drop("_cell")


def within(a: DataFrame, b: DataFrame, key: str, a_at: str, b_start: str, b_end: str, before: float, after: float, width: float) -> DataFrame:
    """Pairs with b.start <= at + after and b.end >= at - before, each once."""
    left = a.withColumn("_lo", F.col(a_at) - before).withColumn("_hi", F.col(a_at) + after).withColumn("_cell", cells("_lo", "_hi", width))
    right = b.withColumn("_cell", cells(b_start, b_end, width))
    first = F.greatest(time_bucket("_lo", width), time_bucket(b_start, width))
    return left.join(right, [key, "_cell"]).filter(
        (F.col("_cell") == first) & (F.col(b_start) <= F.col("_hi")) & (F.col(b_end) >= F.col("_lo"))).drop("_cell", "_lo", "_hi")


def nearest_distance(a: DataFrame, b: DataFrame, key: str, a_at: str, b_at: str, reach: float, ids: list[str]) -> DataFrame:
    """Smallest |a.at - b.at| below ``reach`` per row of ``a`` (by its id columns)."""
    left = a.select(key, *[c for c in ids if c != key], F.col(a_at).alias("_t")).withColumn(
        "_cell", F.explode(F.sequence(time_bucket(F.col("_t") - reach, reach), time_bucket(F.col("_t") + reach, reach))))
    right = b.select(key, F.col(b_at).alias("_u")).withColumn("_cell", time_bucket("_u", reach))
    d = F.abs(F.col("_t") - F.col("_u"))
    return left.join(right, [key, "_cell"]).filter(d < reach).groupBy(*ids).agg(F.min(d).alias("distance"))


def link_timestamps(comments: DataFrame, segments: DataFrame) -> DataFrame:
    """Quoted seconds of comments tied to the first segment that holds them.

    Equal seconds of a video are looked up once, and of equal intervals only the one with the smallest id, so many comments on one
    moment of a video with many segments there do not meet one by one.
    """
    said = comments.select(F.col("id").alias("comment_id"), "video_id", F.explode("ts_seconds").alias("second")).distinct()
    spans = segments.groupBy("video_id", "start_time", "end_time").agg(F.min("id").alias("segment_id"))
    hit = points_in_intervals(said.select("video_id", "second").distinct(), spans, "video_id", "second", "start_time", "end_time", 15.0)
    first = hit.groupBy("video_id", "second").agg(F.min_by("segment_id", F.struct("start_time", "segment_id")).alias("segment_id"))
    return said.join(first, ["video_id", "second"]).select("comment_id", "video_id", "second", "segment_id")


def nearby_ocr(segments: DataFrame, frames: DataFrame, reach: float = 20.0, k: int = 5) -> DataFrame:
    """Distinct on-screen texts of the first k frames near a segment's start."""
    from .ordered import top_n_per_key
    left = segments.select(F.col("id").alias("segment_id"), "video_id", F.col("start_time").alias("at"))
    right = frames.filter("ocr_text <> ''").select("video_id", F.col("id").alias("frame_id"), "timestamp", "ocr_text")
    left = left.withColumn("_cell", F.explode(F.sequence(time_bucket(F.col("at") - reach, reach), time_bucket(F.col("at") + reach, reach))))
    near = left.join(right.withColumn("_cell", time_bucket("timestamp", reach)), ["video_id", "_cell"]).filter(F.abs(F.col("timestamp") - F.col("at")) < reach)
    first = top_n_per_key(near.drop("_cell"), "segment_id", [F.asc("timestamp"), F.asc("frame_id")], k)
    return first.groupBy("segment_id").agg(F.array_join(F.array_sort(F.collect_set("ocr_text")), " ").alias("ocr_text"))


def curve_at(curve: DataFrame, times: DataFrame, rate_hz: float) -> DataFrame:
    """Curve value of the bucket a time falls into, else the curve's mean."""
    mean = curve.groupBy("video_id", "curve_type").agg(F.avg("value").alias("mean"))
    t = times.withColumn("bucket", F.floor(F.col("at") * rate_hz).cast("long"))
    hit = t.join(mean, "video_id").join(curve.hint(DENSE), ["video_id", "curve_type", "bucket"], "left")
    return hit.select(*times.columns, "curve_type", F.coalesce("value", "mean").alias("value"))


def new_only(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Incoming rows of keys not stored yet; of several rows of a key the last by its columns."""
    from ..sources.readers import latest_per_key
    return latest_per_key(incoming.join(existing.select(key), key, "left_anti"), [key]).select(*incoming.columns)


def score_all(vectors: DataFrame, labels: DataFrame, block: int = 1024) -> DataFrame:
    """(id, category, label, similarity) of every vector with every label, in blocks.

    Each block of labels is gathered into one row of bounded size; the rows of the vector table meet the blocks on the block
    number, so any number of labels works and neither table is held whole.
    """
    from ..functions.scores import cosine
    blocks = max(1, -(-labels.count() // block))
    number = F.pmod(F.xxhash64("category", "label"), F.lit(blocks)).cast("int")
    packed = labels.groupBy(number.alias("_block")).agg(F.collect_list(F.struct("category", "label", "label_vector")).alias("_labels"))
    each = vectors.select("id", "vector", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")).join(packed, "_block")
    each = each.select("id", "vector", F.explode("_labels").alias("l"))
    return each.select("id", "l.category", "l.label", cosine(F.col("vector"), F.col("l.label_vector")).alias("similarity"))
