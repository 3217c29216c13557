"""Listing, filtering and paging operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.numbers import col
from .ordered import time_bucket, top_n_per_key, with_position

# --- fixed: caps of the data model
MAX_SEGMENTS, MAX_FRAMES, MAX_EMBEDDINGS = 10_000, 8_000, 10_000


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def search_filter(df: DataFrame, language=None, min_confidence=None, channels=None, platform=None, tags=None, min_duration=None,
                  max_duration=None, min_views=None, max_views=None, uploaded_after=None, uploaded_before=None, modality=None) -> DataFrame:
    """Conjunction of the given conditions; plain comparisons reach the Parquet scan."""
    tests = [
        (language, lambda v: F.col("language") == v), (min_confidence, lambda v: F.col("confidence") >= v),
        (channels, lambda v: F.col("channel_id").isin(list(v))), (platform, lambda v: F.col("platform") == v),
        (tags, lambda v: F.arrays_overlap("tags", F.array(*[F.lit(t) for t in v]))),
        (min_duration, lambda v: F.col("duration_seconds") >= v), (max_duration, lambda v: F.col("duration_seconds") <= v),
        (min_views, lambda v: F.col("view_count") >= v), (max_views, lambda v: F.col("view_count") <= v),
        (uploaded_after, lambda v: F.col("uploaded_at") >= F.lit(v).cast("timestamp")),
        (uploaded_before, lambda v: F.col("uploaded_at") <= F.lit(v).cast("timestamp")), (modality, lambda v: F.col("modality") == v),
    ]
    for value, test in tests:
        if value is not None:
            df = df.filter(test(value))
    return df


def list_videos(videos, segments, frames, channels, status=None, platform=None, number: int = 1, size: int = 50) -> DataFrame:
    """Newest videos with child counts. The page is cut first, so children are counted for its videos only."""
    if status:
        videos = videos.filter(F.col("status") == status)
    if platform:
        videos = videos.filter(F.col("platform") == platform)
    rows = page(videos, [F.desc("uploaded_at"), F.asc("id")], number, size)

    def children(df, name):
        wanted = df.join(rows.select(F.col("id").alias("video_id")), "video_id", "left_semi")
        return wanted.groupBy(F.col("video_id").alias("id")).agg(F.count(F.lit(1)).alias(name))

    named = channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel_name"))
    return (rows.join(children(segments, "segment_count"), "id", "left").join(children(frames, "frame_count"), "id", "left")
            .join(named, "channel_id", "left").fillna(0, ["segment_count", "frame_count"]))


def video_detail(videos: DataFrame, parts: dict[str, tuple[DataFrame, str]], video_id=None) -> DataFrame:
    """Videos with their children as ordered rows: (video_id, section, position, body).

    ``parts`` maps a section to (frame, order column). Rows instead of nested lists keep a long video splittable.
    """
    if video_id is not None:
        videos = videos.filter(F.col("id") == video_id)
    ids = videos.select(F.col("id").alias("video_id"))
    body = [c for c in videos.columns if c != "id"]
    out = videos.select(F.col("id").alias("video_id"), F.lit("video").alias("section"), F.lit(0.0).alias("position"),
                        F.to_json(F.struct(*body)).alias("body"))
    for section, (df, order) in parts.items():
        rows = df.join(ids, "video_id", "left_semi")
        body = [c for c in rows.columns if c != "video_id"]
        out = out.unionByName(rows.select("video_id", F.lit(section).alias("section"), F.col(order).cast("double").alias("position"),
                                          F.to_json(F.struct(*body)).alias("body")))
    return out


def list_comments(comments, authors=None, video_id=None, statuses=("processed", "pending"), sort: str = "likes", number=1, size=50):
    orders = {"likes": F.desc("like_count"), "newest": F.desc("timestamp_posted"), "oldest": F.asc("timestamp_posted"),
              "sentiment": F.desc("sentiment_score")}
    df = comments.filter(F.col("status").isin(list(statuses)))
    if video_id is not None:
        df = df.filter(F.col("video_id") == video_id)
    rows = page(df, [orders[sort], F.asc("id")], number, size)
    return rows if authors is None else rows.join(authors, "author_id", "left")


def list_audio_segments(audio, video_id=None, source=None, min_music=None, number=1, size=100):
    if video_id is not None:
        audio = audio.filter(F.col("video_id") == video_id)
    if source:
        audio = audio.filter(F.col("dominant_source") == source)
    if min_music is not None:
        audio = audio.filter(F.col("music_probability") >= min_music)
    return page(audio, [F.asc("start_time"), F.asc("id")], number, size)


def search_audio_events(audio, event: str, min_confidence: float = 0.3, limit: int = 50, videos=None):
    """Windows tagged with the event, or dominated by it; the cut comes after the match."""
    tagged = F.exists("event_tags", lambda t: (F.lower(t["label"]) == event.lower()) & (t["confidence"] >= min_confidence))
    hit = audio.filter(tagged | (F.lower("dominant_source") == event.lower())).withColumn("matched_tag", tagged)
    first = F.desc("music_probability") if event.lower() == "music" else F.asc("start_time")
    rows = hit.orderBy(first, "video_id", "id").limit(limit)
    return rows if videos is None else rows.join(videos, "video_id")


def change_points_of(points, video_id=None, min_magnitude: float = 0.0):
    if video_id is not None:
        points = points.filter(F.col("video_id") == video_id)
    return points.filter(F.col("magnitude") >= min_magnitude).orderBy("video_id", "timestamp")


def by_transition(points, transition: str, limit: int = 50):
    return points.filter(F.col("transition_type") == transition).orderBy(F.desc("magnitude"), "video_id", "timestamp").limit(limit)


def signal_records(signal, video_id=None, channel_id=None, order: list[Column] | None = None, number=1, size=50):
    if video_id is not None:
        signal = signal.filter(F.col("video_id") == video_id)
    if channel_id is not None:
        signal = signal.filter(F.col("channel_id") == channel_id)
    return page(signal, order or [F.col(c) for c in signal.columns], number, size)


def graph_relational_signals(migrations, propagations, parasocial, gestations, channel_id=None, author_id=None, entity_id=None):
    """Frames of the four relational signals; a migration matches on either channel."""
    def pick(df, tests):
        for test in tests:
            df = df.filter(test) if test is not None else df
        return df

    def given(value, test):
        return None if value is None else test

    by_author = given(author_id, F.col("author_id") == author_id)
    by_channel = given(channel_id, F.col("channel_id") == channel_id)
    by_entity = given(entity_id, F.col("entity_id") == entity_id)
    either = given(channel_id, (F.col("from_channel") == channel_id) | (F.col("to_channel") == channel_id))
    return {
        "commenter_migrations": pick(migrations, [either, by_author]), "entity_propagations": pick(propagations, [by_entity]),
        "parasocial_indices": pick(parasocial, [by_channel, by_author]), "topic_gestations": pick(gestations, [by_channel, by_entity]),
    }


def unified_signals(signals: dict[str, DataFrame], key: str = "video_id", value=None) -> DataFrame:
    """(signal, key, payload) over all signal tables that carry the key."""
    out = None
    for name, df in signals.items():
        if key not in df.columns:
            continue
        if value is not None:
            df = df.filter(F.col(key) == value)
        row = df.select(F.lit(name).alias("signal"), F.col(key), F.to_json(F.struct(*df.columns)).alias("payload"))
        out = row if out is None else out.unionByName(row)
    return out


def signal_counts(signals: dict[str, DataFrame], key: str = "video_id") -> DataFrame:
    parts = [df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("signal"), key, "n")
             for name, df in signals.items() if key in df.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# signals about entities, which belong to no channel
ENTITY_SIGNALS = ("entity_propagations",)


def channel_signals(signals: dict[str, DataFrame], videos: DataFrame, channel_id) -> DataFrame:
    """Signals of a channel: by its id, by either end of a migration, or through its videos. Entity signals are left out.

    A table that has none of these columns is an error.
    """
    mine = videos.filter(F.col("channel_id") == channel_id).select(F.col("id").alias("video_id"))
    out = None
    for name, df in signals.items():
        if name in ENTITY_SIGNALS:
            continue
        if "channel_id" in df.columns:
            df = df.filter(F.col("channel_id") == channel_id)
        elif "from_channel" in df.columns:
            df = df.filter((F.col("from_channel") == channel_id) | (F.col("to_channel") == channel_id))
        elif "video_id" not in df.columns:
            raise ValueError(f"{name} has no channel_id, from_channel or video_id")
        else:
            df = df.join(mine, "video_id", "left_semi")
        row = df.select(F.lit(name).alias("signal"), F.to_json(F.struct(*df.columns)).alias("payload"))
        out = row if out is None else out.unionByName(row)
    return out


def list_nodes(nodes, node_type=None, number=1, size=50):
    return page(nodes if node_type is None else nodes.filter(F.col("node_type") == node_type), [F.asc("node_type"), F.asc("id")], number, size)


def list_metric_points(points, source=None, metric_type=None, skip: int = 0, limit: int = 100):
    if source is not None:
        points = points.filter(F.col("source") == source)
    if metric_type is not None:
        points = points.filter(F.col("metric_type") == metric_type)
    return points.orderBy(F.desc("timestamp"), "id").offset(skip).limit(limit)


def cap_per_video(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return top_n_per_key(df, "video_id", [F.asc(c) for c in order], n, "_rank").drop("_rank")


def sample_frames(frames: DataFrame, every: int, blur_threshold: float, cap: int | None = None) -> DataFrame:
    """Every k-th frame that is sharp or a scene change; ``cap`` (MAX_FRAMES in the described model) limits them per video."""
    placed = with_position(frames, "video_id", ["timestamp", "id"], time_bucket("timestamp", 600))
    kept = placed.filter((F.col("pos") % every == 0) & ((F.col("blur_score") >= blur_threshold) | F.col("is_scene_change")))
    return kept.drop("n") if cap is None else cap_per_video(kept.drop("n"), cap, ["pos"])


def eligible_videos(videos: DataFrame, as_of: str, rules: dict | None = None) -> DataFrame:
    rules = rules or L.PRIORITY_RULES
    df = videos.filter(
        F.col("duration_seconds").between(rules["min_duration_seconds"], rules["max_duration_seconds"])
        & (F.col("view_count") >= rules["min_views"])
        & (F.col("uploaded_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {rules['max_age_days']} days")))
    return df.filter(F.col("language").isin(rules["accepted_languages"])) if rules["accepted_languages"] else df


def admit_comments(comments: DataFrame, min_likes=0, min_reply_likes=0, max_urls=3, max_caps=0.7) -> DataFrame:
    """Comments passing the intake rules; a text repeated by its author is kept once."""
    from ..functions.text import occurrences
    n = F.length("text")
    caps = F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) / F.greatest(n, F.lit(1))
    floor = F.when(F.col("parent_comment_id").isNull(), min_likes).otherwise(min_reply_likes)
    ok = comments.filter((F.col("like_count") >= floor) & (occurrences(F.col("text"), "http") <= max_urls) & (caps <= max_caps))
    norm = F.lower(F.trim("text"))
    first = ok.groupBy("author_id", norm.alias("_t")).agg(F.min(F.struct("timestamp_posted", "id")).alias("_f"))
    return ok.join(first.select(F.col("_f.id").alias("id")), "id", "left_semi")


def prune_authors(authors: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
    return authors.withColumn("is_pruned", F.coalesce(F.col("last_seen_at") < limit, F.lit(False)))


def evaluation_history(metrics: DataFrame, n: int = 50) -> DataFrame:
    return metrics.orderBy(F.desc("created_at"), "id").limit(n)
