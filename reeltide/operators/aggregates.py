"""Summary tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.numbers import rnd
from .ordered import top_n_per_key


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _long(row: DataFrame) -> DataFrame:
    """One-row aggregate turned into (metric, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def system_metrics(tables: dict[str, DataFrame]) -> DataFrame:
    """(metric, value) of every given table, each scanned once."""
    parts = []
    for name, df in tables.items():
        aggs = [F.count(F.lit(1)).alias(f"total_{name}")]
        if name == "videos":
            aggs += [F.count_if(F.col("status") == s).alias(f"{s}_videos") for s in ("indexed", "queued", "failed")]
        if name == "feedback":
            up, down = [F.count_if(F.col("feedback_type") == t) for t in ("upvote", "downvote")]
            aggs.append(rnd(up / F.greatest(up + down, F.lit(1)), 4).alias("upvote_ratio"))
        if name == "alignments":
            aggs += [F.count_if(F.col("quality_level").isin("poor", "mismatch")).alias("total_alignment_warnings"),
                     F.coalesce(rnd(F.avg("alignment_score"), 3), F.lit(0.0)).alias("avg_alignment_score")]
        parts.append(_long(df.agg(*aggs)))
    return _stack(parts)


def feedback_stats(df: DataFrame) -> DataFrame:
    up, down = [F.count_if(F.col("feedback_type") == t) for t in ("upvote", "downvote")]
    return df.agg(
        F.count(F.lit(1)).alias("total"), up.alias("upvotes"), down.alias("downvotes"),
        F.count_if(F.col("feedback_type") == "timestamp_correction").alias("timestamp_corrections"),
        F.count_if(F.col("feedback_type") == "mismatch_report").alias("mismatch_reports"),
        rnd(up / F.greatest(up + down, F.lit(1)), 4).alias("upvote_ratio"))


def comment_stats(df: DataFrame) -> DataFrame:
    n, spam = F.count(F.lit(1)), F.count_if(F.col("status") == "spam")
    return df.agg(
        n.alias("total"), F.count_if(F.col("status") == "processed").alias("processed"), F.count_if(F.col("status") == "pending").alias("pending"),
        spam.alias("spam"), F.count_if(F.col("status") == "toxic").alias("toxic"), rnd(F.avg("depth_level"), 2).alias("avg_depth"),
        F.max("depth_level").alias("max_depth"), rnd(spam / F.greatest(n, F.lit(1)), 4).alias("spam_rate"))


def audio_summary(audio: DataFrame) -> DataFrame:
    length = F.col("end_time") - F.col("start_time")
    base = audio.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("total_windows"), rnd(F.sum(length), 2).alias("duration_seconds"), rnd(F.avg("bpm"), 1).alias("global_bpm"),
        F.avg("overall_manipulation").alias("m"),
        *[rnd(F.coalesce(F.sum(F.when(F.col("dominant_source") == s, length)), F.lit(0.0)), 2).alias(f"total_{s}_seconds")
          for s in ("music", "speech", "silence")])
    by_source = audio.groupBy("video_id", "dominant_source").agg(rnd(F.sum(length), 3).alias("s"))
    source = by_source.groupBy("video_id").agg(F.min_by("dominant_source", F.struct(-F.col("s"), F.col("dominant_source"))).alias("dominant_source"))
    by_key = audio.filter("musical_key is not null").groupBy("video_id", "musical_key").agg(F.count(F.lit(1)).alias("c"))
    mode = by_key.groupBy("video_id").agg(F.min_by("musical_key", F.struct(-F.col("c"), F.col("musical_key"))).alias("global_key"))
    return (base.join(source, "video_id").join(mode, "video_id", "left")
            .withColumn("manipulation_summary", F.when(F.col("m") > 0.1, rnd("m", 3))).drop("m"))


def audio_overview(audio: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct("video_id") if approximate else F.count_distinct("video_id")
    return audio.agg(
        F.count(F.lit(1)).alias("total_segments"), distinct.alias("videos"), rnd(F.avg("music_probability"), 3).alias("avg_music"),
        rnd(F.avg("speech_probability"), 3).alias("avg_speech"), F.count_if(F.col("overall_manipulation") > 0.4).alias("manipulated"))


def top_authors(authors: DataFrame, n: int = 20) -> DataFrame:
    return authors.filter(~F.col("is_pruned")).orderBy(F.desc("comment_count"), "author_id").limit(n)


def entity_counts(mentions: DataFrame, min_mentions: int = 2) -> DataFrame:
    name = F.lower(F.trim("canonical_name"))
    return mentions.filter(F.length(name) >= 2).groupBy(name.alias("canonical_name"), "entity_type").agg(
        F.count(F.lit(1)).alias("mention_count"), F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"),
    ).filter(F.col("mention_count") >= min_mentions)


def top_entities(entities: DataFrame, n: int = 20, entity_type=None) -> DataFrame:
    if entity_type:
        entities = entities.filter(F.col("entity_type") == entity_type)
    return entities.orderBy(F.desc("mention_count"), "canonical_name", "entity_type").limit(n)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per node type and edge type with their totals."""
    def counted(df, kind, name):
        return df.rollup(kind).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("part"), F.coalesce(F.col(kind), F.lit("total")).alias("type"), "n")
    return counted(nodes, "node_type", "nodes").unionByName(counted(edges, "edge_type", "edges"))


def signal_stats(counts: DataFrame) -> DataFrame:
    """Rollup of (signal, n) rows by category and signal."""
    category = F.lit("other")
    for name, members in L.SIGNAL_CATEGORIES.items():
        category = F.when(F.col("signal").isin(members), name).otherwise(category)
    return counts.withColumn("category", category).rollup("category", "signal").agg(F.sum("n").alias("n")).select(
        F.coalesce("category", F.lit("all")).alias("category"), F.coalesce("signal", F.lit("all")).alias("signal"), "n")


def recrawl_stats(events: DataFrame) -> DataFrame:
    by_trigger = events.groupBy("trigger").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.concat(F.lit("trigger:"), "trigger").alias("metric"), "value")
    by_field = events.select(F.explode("fields_changed").alias("f")).groupBy("f").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.concat(F.lit("field:"), "f").alias("metric"), "value")
    totals = _long(events.agg(
        F.count(F.lit(1)).alias("total"), rnd(F.avg("comments_added"), 1).alias("avg_comments_added"),
        rnd(F.avg("comments_deleted"), 1).alias("avg_comments_deleted"), F.count_if("title_changed").alias("title_changes"),
        F.count_if("description_changed").alias("description_changes")))
    return _stack([totals, by_trigger, by_field])


def author_profiles(comments: DataFrame) -> DataFrame:
    """Sentiment and topic maps of processed comments."""
    c = comments.filter("status = 'processed'")
    label = F.coalesce("sentiment_label", F.lit("neutral"))
    base = c.groupBy("author_id").agg(
        F.create_map(*[x for s in ("positive", "negative", "neutral") for x in (F.lit(s), F.count_if(label == s))]).alias("sentiment_distribution"),
        F.count(F.lit(1)).alias("comment_count"))
    topics = c.select("author_id", F.explode("topic_labels").alias("t")).groupBy("author_id", "t").agg(F.count(F.lit(1)).alias("n"))
    topics = topics.groupBy("author_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("topic_frequency"))
    return base.join(topics, "author_id", "left")


def change_point_summary(points: DataFrame) -> DataFrame:
    base = points.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("total_change_points"), (F.count(F.lit(1)) + 1).alias("num_scenes"), F.max("timestamp").alias("last_timestamp"))
    kinds = points.groupBy("video_id", "transition_type").agg(F.count(F.lit(1)).alias("c"))
    best = top_n_per_key(kinds, "video_id", [F.desc("c"), F.asc("transition_type")], 3)
    best = best.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "transition_type"))),
                                                    lambda x: x["transition_type"]).alias("dominant_transitions"))
    return base.join(best, "video_id")


def quality_level(score) -> F:
    return F.when(score >= 0.80, "good").when(score >= 0.55, "acceptable").when(score >= 0.30, "poor").otherwise("mismatch")


def alignment_summary(rows: DataFrame) -> DataFrame:
    """One row per video; ``mismatch_regions`` are its poor and mismatched stretches in order of time."""
    bad = F.col("quality_level").isin("poor", "mismatch")
    g = rows.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("segments"), F.avg("alignment_score").alias("s"), F.sum(F.size("warnings")).alias("total_warnings"),
        F.count_if(bad).alias("mismatch_count"), F.array_sort(F.collect_list(F.when(bad, F.struct("start_time", "end_time")))).alias("mismatch_regions"))
    return g.select("video_id", "segments", rnd("s", 3).alias("overall_score"), quality_level(F.col("s") + 1e-9).alias("overall_quality"),
                    "total_warnings", "mismatch_count", "mismatch_regions")


def mismatch_regions(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("quality_level").isin("poor", "mismatch")).select("video_id", "start_time", "end_time", "quality_level")


def chart_data(points, metric_types, start, end, group_by: str = "day", limit: int = 100, filters: dict | None = None) -> DataFrame:
    df = points.filter(F.col("metric_type").isin(list(metric_types)) & (F.col("timestamp") >= F.lit(start).cast("timestamp"))
                       & (F.col("timestamp") < F.lit(end).cast("timestamp")))
    for name, value in (filters or {}).items():
        df = df.filter(F.col(name) == value)
    g = df.groupBy("metric_type", F.date_trunc(group_by, "timestamp").alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"), rnd(F.avg("value"), 4).alias("average"))
    return top_n_per_key(g, "metric_type", [F.desc("bucket")], limit).drop("rank")


def datapoint_stats(points: DataFrame) -> DataFrame:
    n, active = F.count(F.lit(1)), F.count_if("is_active")
    return points.agg(n.alias("total_points"), F.count_distinct(F.when(F.col("is_active"), F.col("source"))).alias("active_sources"),
                      rnd(active / F.greatest(n, F.lit(1)) * 100, 2).alias("success_rate"))


def topic_counts(assignments: DataFrame, channel_of: DataFrame | None = None) -> DataFrame:
    keys = ["topic_id", "source_type"]
    if channel_of is not None:
        assignments, keys = assignments.join(channel_of, "source_id"), [*keys, "channel_id"]
    return assignments.groupBy(*keys).agg(F.count(F.lit(1)).alias("mentions"))
