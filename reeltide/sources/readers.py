"""Readers, writers and keyed updates."""
from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.urls import detect_platform

INFO_SCHEMA = (
    "id string, title string, description string, webpage_url string, thumbnail string, duration double, view_count bigint, like_count bigint, dislike_count bigint, comment_count bigint, "
    "age_limit int, channel string, uploader string, channel_id string, uploader_id string, upload_date string, language string, tags array<string>, categories array<string>, live_status string, "
    "was_live boolean, is_live boolean, chapters array<struct<title:string,start_time:double,end_time:double>>, subtitles map<string,string>, automatic_captions map<string,string>"
)
# --- fixed: keys kept from the record beyond the columns
OVERFLOW_KEYS = [
    "webpage_url", "extractor", "format_id", "format_note", "fps", "width", "height", "vcodec", "acodec", "abr", "vbr", "tbr", "asr", "filesize_approx", "stretched_ratio", "availability",
    "original_url", "channel_follower_count", "uploader_url", "license", "series", "season_number", "episode_number", "track", "artist", "album", "release_year",
]
LIVE_STATES = ["is_live", "was_live", "is_upcoming", "post_live"]


def read_channel_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``url | tier``; blank lines and comments are skipped."""
    line = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' and not v like '#%'")
    parts = F.split("v", r"\|")
    tier = F.coalesce(F.trim(F.get(parts, F.lit(1))).try_cast("int"), F.lit(1))
    url = F.trim(F.get(parts, F.lit(0)))
    return line.select(url.alias("url"), tier.alias("priority_tier"), detect_platform(url).alias("platform"))


def read_video_info(spark: SparkSession, path: str, max_auto_captions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(videos, chapters) from one JSON record per line. ``max_auto_captions`` (50 in the described model) limits that list."""
    raw = spark.read.text(path)
    r = raw.select(F.from_json("value", INFO_SCHEMA).alias("r"), F.from_json("value", "map<string,string>").alias("all"))
    r = r.select("r.*", "all").withColumn("platform", detect_platform(F.coalesce("webpage_url", F.lit(""))))
    live = F.when(F.coalesce("is_live", F.lit(False)), "is_live").when(F.col("live_status").isin(LIVE_STATES), F.col("live_status")).when(F.coalesce("was_live", F.lit(False)), "was_live").otherwise("none")
    subs, auto = [F.coalesce(F.map_keys(c), F.array().cast("array<string>")) for c in ("subtitles", "automatic_captions")]
    videos = r.select(
        F.concat_ws(":", "platform", "id").alias("platform_id"), "platform", "title", "description", F.col("webpage_url").alias("url"), F.col("thumbnail").alias("thumbnail_url"),
        F.col("duration").alias("duration_seconds"), "view_count", "like_count", "dislike_count", "comment_count", "age_limit", F.coalesce("channel", "uploader").alias("channel_name"),
        F.coalesce("channel_id", "uploader_id").alias("channel_id"), X.uploaded_at("upload_date").alias("uploaded_at"), "language", "tags", "categories", live.alias("live_status"),
        F.contains(F.coalesce("webpage_url", F.lit("")), F.lit("shorts")).alias("is_short"), (F.size(subs) > 0).alias("has_captions"), F.array_sort(subs).alias("caption_languages"),
        (F.size(auto) > 0).alias("has_auto_captions"), (F.array_sort(auto) if max_auto_captions is None else F.slice(F.array_sort(auto), 1, max_auto_captions)).alias("auto_caption_languages"),
        F.map_filter("all", lambda k, v: k.isin(OVERFLOW_KEYS) & v.isNotNull()).alias("metadata"))
    chapters = r.select(F.concat_ws(":", "platform", "id").alias("platform_id"), F.explode("chapters").alias("c")).select(
        "platform_id", F.coalesce("c.title", F.lit("")).alias("title"), F.coalesce("c.start_time", F.lit(0.0)).alias("start_time"), F.col("c.end_time").alias("end_time"))
    return videos, chapters


RAW_COMMENT = "id string, author string, author_id string, text string, like_count bigint, parent string, timestamp string, is_pinned boolean, platform string, video_id string"


def read_comment_dump(spark: SparkSession, path: str, platform: str | None = None) -> DataFrame:
    r = spark.read.schema(RAW_COMMENT).json(path)
    p = F.lit(platform) if platform else F.coalesce("platform", F.lit("other"))
    return r.select(
        p.alias("platform"), X.comment_key(p, "id", "author", "text", "timestamp").alias("platform_comment_id"), F.coalesce("author_id", "author", F.lit("unknown")).alias("author_id"),
        F.coalesce("author", F.lit("Unknown")).alias("author_display_name"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("like_count", F.lit(0)).alias("like_count"),
        F.coalesce("parent", F.lit("root")).alias("parent_id"), X.parse_posted("timestamp").alias("timestamp_posted"), F.coalesce("is_pinned", F.lit(False)).alias("is_pinned"), "video_id")


def read_subtitles(spark: SparkSession, path: str, max_chars: int | None = None, named_by_folder: bool = False) -> DataFrame:
    """Whole srt, vtt and ass files named ``<video>.<lang>[.auto].<ext>``; a manual file wins over an automatic one.

    ``max_chars`` (500 000 in the described model) cuts the content. ``named_by_folder`` takes the names from folders ``_name=...``.
    """
    name = F.regexp_extract("_metadata.file_path", "_name=([^/]+)/", 1) if named_by_folder else F.col("_metadata.file_name")
    f = spark.read.text(path, wholetext=True).select("value", name.alias("name"))
    pattern = r"^(.*?)\.([^.]+?)(\.auto)?\.(srt|vtt|ass)$"
    f = f.filter(F.col("name").rlike(pattern)).select(
        F.regexp_extract("name", pattern, 1).alias("video_id"), F.regexp_extract("name", pattern, 2).alias("language"), (F.regexp_extract("name", pattern, 3) != "").alias("is_auto_generated"),
        F.regexp_extract("name", pattern, 4).alias("format"), (F.col("value") if max_chars is None else F.substring("value", 1, max_chars)).alias("content"))
    rank = F.struct("is_auto_generated", F.when(F.col("format") == "srt", 0).when(F.col("format") == "vtt", 1).otherwise(2))
    best = f.groupBy("video_id", "language").agg(F.min_by(F.struct("is_auto_generated", "format", "content"), rank).alias("b")).select("video_id", "language", "b.*")
    return best.withColumn("cue_count", F.greatest(X.occurrences(F.col("content"), "\n\n"), F.lit(1)))


def write_named_texts(df: DataFrame, path: str, name: str, text: str) -> None:
    """A folder per name below path with one text file; rows of the same name are its lines, in no fixed order."""
    df.select(F.col(name).alias("_name"), F.col(text).alias("value")).repartition("_name").write.partitionBy("_name").text(path)


def read_calibration_samples(spark: SparkSession, path: str, one_a_line: bool = False) -> DataFrame:
    """JSON objects ``{target: [{raw, truth}, ...]}``, one per file, or per line."""
    m = spark.read.text(path, wholetext=not one_a_line).select(F.from_json("value", "map<string,array<struct<raw:double,truth:int>>>").alias("m"))
    return m.select(F.explode("m").alias("target", "samples")).select("target", F.explode("samples").alias("s")).select("target", "s.raw", "s.truth")


def read_rules(path: str, spark: SparkSession | None = None) -> dict:
    """Weights, priority rules or limits from a small YAML file, as parameters; JSON is YAML too and needs no library.

    With a session the file, or folder of one file, is read by Spark, so it may lie in a store that only Spark reaches.
    """
    if spark is None:
        with open(path) as f:
            text = f.read()
    else:
        text = spark.read.text(path, wholetext=True).first()[0]
    try:
        return json.loads(text)
    except ValueError:
        import yaml
        return yaml.safe_load(text) or {}


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(os.path.join(folder, n)) for n in names}


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


# ---- keyed updates -----------------------------------------------------------------------

def latest_per_key(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the last by ``order``, and by the other columns where that ties, so the choice is repeatable."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    by = [*(order or []), *[c for c in rest if c not in (order or [])]]
    rank = F.struct(*[F.col(c) if not isinstance(df.schema[c].dataType, T.MapType) else F.to_json(c) for c in by])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row")).select(*keys, "_row.*")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], as_of: str, order: list[str] | None = None) -> DataFrame:
    """Rows matched on the keys take the incoming non-null values; the others are added or kept.

    Of incoming rows with one key the last by ``order`` counts. New columns are taken over, null for rows not touched.
    """
    types = {**{f.name: f.dataType for f in incoming.schema}, **{f.name: f.dataType for f in existing.schema}}
    fields = [c for c in dict.fromkeys([*existing.columns, *incoming.columns]) if c not in [*keys, "updated_at"]]

    def side(df, c):
        return F.col(c) if c in df.columns else F.lit(None).cast(types[c])

    new = latest_per_key(incoming, keys, order)
    n = new.select(*keys, *[side(new, c).alias(f"n_{c}") for c in fields], F.lit(True).alias("_new"))
    o = existing.select(*keys, *[side(existing, c).alias(c) for c in fields], *(["updated_at"] if "updated_at" in existing.columns else []))
    touched = F.col("_new").isNotNull()
    return o.join(n, keys, "full").select(*keys, *[F.coalesce(f"n_{c}", c).alias(c) for c in fields], F.when(touched, F.lit(as_of).cast("timestamp")).otherwise(
        F.col("updated_at") if "updated_at" in existing.columns else F.lit(None).cast("timestamp")).alias("updated_at"))


def upsert_vectors(existing: DataFrame, incoming: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """Incoming points, the latest of each id, replace stored ones of the same id."""
    kept = existing.join(incoming.select(key).distinct(), key, "left_anti")
    return kept.unionByName(latest_per_key(incoming, [key], order), allowMissingColumns=True)


def delete_by_video(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("video_id").distinct(), "video_id", "left_anti")


def enum_is(column: Column | str, values: list[str]) -> Column:
    """Validation predicate for an enumerated column."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNull() | c.isin(values)


def stream_table(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table of a folder, one file or a folder of part files, as a stream.

    What is stored at the start is one batch, in which no row is late, whatever the order of the files. ``files_per_batch`` deals it out;
    operators with a watermark then drop rows of files that come later than their delay.
    """
    r = spark.readStream.schema(schema)
    r = r if files_per_batch is None else r.option("maxFilesPerTrigger", files_per_batch)
    # as a pattern the path may be a file; a plain one has to be a folder
    return r.parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")
