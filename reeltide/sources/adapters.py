"""Views of the supplied tables as the video/discussion model, all rows of every table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import time_bucket, with_next


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; zoneless timestamps are read as UTC instants, which keeps filters on them in the scan."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    fields = [T.StructField(f.name, T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType) for f in df.schema]
    df = df if fields == list(df.schema) else spark.read.schema(T.StructType(fields)).parquet(path)
    return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


# tables whose rows cost much work each
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "embeddings": "vec_id"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table with fewer file splits than cores, spread by key; a table of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def comments(spark, sf_dir) -> DataFrame:
    return comments_from(table(spark, sf_dir, "conversations"))


def comments_from(c: DataFrame) -> DataFrame:
    odd = F.col("conv_id") % 2 == 1
    parent = F.when(odd, F.col("turn") - 1).otherwise(F.floor((F.col("turn") - 1) / 2))
    depth = F.when(odd, F.col("turn")).otherwise(F.floor(F.log2((F.col("turn") + 1).cast("double")) + 1e-9))
    sentiment = ((F.col("conv_id") * 31 + F.col("turn") * 17) % 21 - 10) / 10
    hours_minutes = F.col("conv_id") * 3600 + F.col("turn") * 60
    mod5 = F.col("turn") % 5
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        (F.col("conv_id") * 100).alias("root_thread_id"),
        F.when(F.col("turn") > 0, F.col("conv_id") * 100 + parent).cast("long").alias("parent_comment_id"),
        depth.cast("long").alias("depth_level"),
        F.concat_ws("_", "role", ((F.col("conv_id") + F.col("turn")) % 7).cast("string")).alias("author_id"),
        (F.col("conv_id") % 10).alias("video_id"),
        (F.col("conv_id") % 4).alias("channel_id"),
        F.timestamp_seconds(F.lit(1704067200) + hours_minutes).alias("timestamp_posted"),
        sentiment.alias("sentiment_score"),
        F.when(F.col("turn") % 7 == 6, None).when(sentiment > 0.2, "positive").when(sentiment < -0.2, "negative")
        .otherwise("neutral").alias("sentiment_label"),
        F.when(F.col("turn") % 6 != 5, (F.col("conv_id") * 13 + F.col("turn") * 7) % 11 / 10).alias("toxicity_score"),
        ((F.col("conv_id") * F.col("turn")) % 150).alias("like_count"),
        F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, "pending").when((F.col("conv_id") + F.col("turn")) % 9 == 1, "spam")
        .otherwise("processed").alias("status"),
        F.when(mod5 == 0, F.array(F.lit("technology"))).when(mod5 == 1, F.array(F.lit("science"), F.lit("gaming")))
        .when(mod5 == 3, F.array(F.lit("music"))).when(mod5 == 4, F.array(F.lit("gaming")))
        .otherwise(F.array().cast("array<string>")).alias("topic_labels"),
        "text",
    )


def raw_comments(spark, sf_dir) -> DataFrame:
    """Comments as a crawler delivers them: keys with a platform prefix, parents with or without it."""
    c = comments(spark, sf_dir)
    parent = F.when(F.col("id") % 2 == 0, F.concat(F.lit("youtube:"), F.col("parent_comment_id"))).otherwise(
        F.col("parent_comment_id").cast("string"))
    return c.select(
        F.lit("youtube").alias("platform"), F.concat(F.lit("youtube:"), F.col("id")).alias("platform_comment_id"),
        F.coalesce(parent, F.lit("root")).alias("parent_id"), "author_id", "video_id",
        F.when(F.col("id") % 13 == 5, "").otherwise(F.col("text")).alias("text"), "like_count", "timestamp_posted",
    )


def videos(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("channel_id"),
        F.when(k % 3 == 0, "youtube").when(k % 3 == 1, "twitch").otherwise("vimeo").alias("platform"),
        F.concat(F.lit("Video "), F.col("o_orderpriority")).alias("title"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), k).alias("url"),
        (k % 20000).alias("duration_seconds"), F.floor("o_totalprice").cast("long").alias("view_count"),
        F.floor(F.col("o_totalprice") / 100).cast("long").alias("like_count"),
        F.when(k % 2 == 0, "en").otherwise("fr").alias("language"), F.col("o_orderdate").alias("uploaded_at"),
        F.when(F.col("o_orderstatus") == "F", "indexed").when(F.col("o_orderstatus") == "O", "queued")
        .otherwise("failed").alias("status"),
        F.array("o_orderpriority", "o_orderstatus").alias("tags"), (k % 2 == 0).alias("has_captions"),
        (F.col("o_totalprice") % 100).alias("priority_score"), F.col("o_orderdate").alias("last_crawled_at"),
    )


def channels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("country"),
        F.floor("c_acctbal").cast("long").alias("subscriber_count"),
        (F.col("c_nationkey") % 5 + 1).cast("long").alias("priority_tier"), (F.col("c_custkey") % 2 == 0).alias("is_active"),
        F.timestamp_seconds(F.lit(946684800) + F.col("c_custkey") * 40000).alias("last_crawled_at"),
    )


def uploads(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("channel_id"), F.col("o_orderkey").alias("video_id"), F.col("o_orderdate").alias("ts"))


def dense_uploads(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("channel_id"), F.col("event_id").alias("video_id"), "ts")


def event_k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def _timeline(spark, sf_dir) -> DataFrame:
    """Events with seconds since the user's first event, 600 real seconds to one."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros("ts")).withColumn("k", event_k())
    first = e.groupBy("user_id").agg(F.min("us").alias("us0"))
    return e.join(first, "user_id").withColumn("start_time", F.floor((F.col("us") - F.col("us0")) / 600000.0) / 1000.0)


def audio_windows(spark, sf_dir) -> DataFrame:
    e = _timeline(spark, sf_dir)
    e = with_next(e, "user_id", ["start_time", "event_id"], time_bucket("start_time", 600), ["start_time"])
    music = (F.col("value") % 100) / 100
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("video_id"), "start_time",
        F.coalesce(F.col("next.start_time"), F.col("start_time") + 5.0).alias("end_time"),
        music.alias("music_probability"), (1 - music).alias("speech_probability"),
        F.when(F.col("k") % 10 != 9, -(F.col("value") % 60)).alias("loudness_lufs"),
        (500 + F.col("value") * 10).alias("spectral_centroid"), ((F.col("k") % 100) / 100).alias("harmonic_ratio"),
        F.when(kind == "view", "speech").when(kind == "click", "music").when(kind == "error", "silence")
        .otherwise("noise").alias("dominant_source"),
        F.array(F.struct(kind.alias("label"), music.alias("confidence"))).alias("event_tags"),
        (60 + F.col("value")).alias("bpm"), F.when(F.col("k") % 5 != 0, F.concat(F.lit("K"), F.col("k") % 12)).alias("musical_key"),
        ((F.col("k") % 50) / 100).alias("overall_manipulation"), ((F.col("k") % 20) / 100).alias("zero_crossing_rate"),
        (F.col("value") % 20).alias("dynamic_range_db"),
    )


def frames(spark, sf_dir) -> DataFrame:
    e = _timeline(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("video_id"), F.col("start_time").alias("timestamp"),
        (F.col("k") % 3 == 0).alias("is_scene_change"), (F.col("value") % 20).cast("int").alias("tag_count"),
        F.concat_ws(" ", "event_type", F.col("k").cast("string")).alias("ocr_text"),
        F.when(F.col("k") % 7 != 0, (F.col("value") % 100) / 100).alias("ocr_confidence"), F.col("value").alias("blur_score"),
        (F.col("k") % 4).alias("face_count"), ((F.col("k") % 10) / 10).alias("face_area"),
    )


def segments(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    s = d.select("doc_id", "lang", "source", F.posexplode(F.split("text", r"\.")).alias("i", "raw"))
    s = s.filter(F.col("raw").rlike(r"\S")).withColumn("text", F.trim(F.regexp_replace("raw", r"\s+", " ")))
    i = F.col("i").cast("long")
    return s.select(
        (F.col("doc_id") * 100000 + i).alias("id"), F.col("doc_id").alias("video_id"), F.col("source").alias("channel_id"),
        (i * 5.0).alias("start_time"), (i * 5.0 + 5.0).alias("end_time"), "text", F.col("lang").alias("language"),
        ((F.col("doc_id") + i) % 10 / 10).alias("confidence"), (((F.col("doc_id") * 7 + i * 5) % 21 - 10) / 10).alias("sentiment"),
    )


def mentions(spark, sf_dir) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("source_id"), F.col("l_suppkey").alias("channel_id"),
        F.col("l_linenumber").alias("position"), F.col("l_shipdate").alias("ts"), F.col("o_custkey").alias("author_id"),
    )


def author_channels(spark, sf_dir) -> DataFrame:
    return mentions(spark, sf_dir).select("author_id", F.col("entity_id").alias("video_id"), "channel_id").distinct()


def feedback(spark, sf_dir) -> DataFrame:
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("video_id"), F.concat(F.lit("q"), F.col("event_id") % 10).alias("query_text"),
        F.when(t == "click", "upvote").when(t == "error", "mismatch_report").when(t == "view", "downvote")
        .otherwise("timestamp_correction").alias("feedback_type"), F.col("ts").alias("created_at"),
    )


def metric_points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("source"),
        F.col("event_type").alias("metric_type"), "value", (F.col("event_id") % 3 != 0).alias("is_active"),
    )


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Video records of an earlier and a later crawl."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    fields = [F.col("p_brand").alias("description"), F.col("p_size").cast("long").alias("view_count")]
    old = p.select(k.alias("platform_id"), F.col("p_name").alias("title"), F.floor("p_retailprice").cast("long").alias("like_count"), *fields)
    new = p.filter(k % 13 != 0).select(
        k.alias("platform_id"), F.when(k % 11 == 0, F.upper("p_name")).when(k % 17 == 0, None).otherwise(F.col("p_name")).alias("title"),
        (F.floor("p_retailprice") + F.when(k % 7 == 0, 1).otherwise(0)).cast("long").alias("like_count"), *fields)
    return old, new


def calibration_samples(spark, sf_dir) -> DataFrame:
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    j = l.join(d, "doc_id").withColumn("raw", F.least(F.col("n_chars") / 4000, F.lit(1.0)))
    return j.select(F.explode(F.array(
        F.struct(F.lit("audio.pitch_shift").alias("target"), "raw", F.col("quality").alias("truth")),
        F.struct(F.lit("ocr.confidence").alias("target"), "raw", F.col("toxic").alias("truth")),
        F.struct(F.lit("clip.label_confidence").alias("target"), "raw", F.col("quality").alias("truth")),
    )).alias("s")).select("s.*")


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("collection"))


def query_vectors(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
