"""Named queries: listing, filtering and summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as G
from ..operators import filters as L
from ..sources import adapters as A
from .catalog_comments import with_entities
from .models_sql import r, raw_words, sql

AUTHORS = "author_id"


def authors(s, d):
    return A.comments(s, d).groupBy("author_id").agg(F.count(F.lit(1)).alias("comment_count"), F.max("timestamp_posted").alias("last_seen_at"))


def mention_rows(s, d):
    from ..operators.comments import entity_mentions
    return entity_mentions(with_entities(s, d))


def nodes(s, d):
    parts = [A.table(s, d, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.lit(n).alias("node_type"))
             for t, k, p, n in (("customer", "c_custkey", "c", "CommentAuthor"), ("supplier", "s_suppkey", "s", "Channel"),
                                ("part", "p_partkey", "p", "Entity"), ("nation", "n_nationkey", "n", "Topic"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def graph_edges(s, d):
    """Customer to supplier with a count, supplier to part, nation to supplier."""
    li, o, sup = A.table(s, d, "lineitem"), A.table(s, d, "orders"), A.table(s, d, "supplier")
    cs = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    cs = cs.select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"),
                   F.lit("ENGAGED_WITH").alias("edge_type"), "weight")
    sp = li.select("l_suppkey", "l_partkey").distinct().select(
        F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"),
        F.lit("MENTIONS").alias("edge_type"), F.lit(1.0).alias("weight"))
    ns = sup.select(F.concat(F.lit("n"), "s_nationkey").alias("source"), F.concat(F.lit("s"), "s_suppkey").alias("target"),
                    F.lit("COVERS").alias("edge_type"), F.lit(1.0).alias("weight"))
    return cs.unionByName(sp).unionByName(ns)


def recrawl_events(s, d):
    """Orders standing in for recorded recrawls."""
    o, k = A.table(s, d, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("id"), F.col("o_orderpriority").alias("trigger"), F.col("o_custkey").alias("video_id"), F.col("o_orderdate").alias("recrawled_at"),
        F.when(k % 2 == 0, F.array(F.lit("title"), F.lit("view_count"))).otherwise(F.array(F.lit("description"))).alias("fields_changed"),
        (k % 7).alias("comments_added"), (k % 3).alias("comments_deleted"), (k % 2 == 0).alias("title_changed"), (k % 2 == 1).alias("description_changed"))


VIDEO_COLS = ["id", "channel_id", "platform", "title", "view_count", "uploaded_at"]

QUERIES = {
    "search_filter": lambda s, d: L.search_filter(
        A.videos(s, d), language="en", platform="youtube", tags=["1-URGENT", "F"], min_duration=100, max_duration=15000, min_views=5000,
        max_views=400000, uploaded_after="1996-01-01", uploaded_before="2000-12-31").select(*VIDEO_COLS),
    "list_videos": lambda s, d: L.list_videos(A.videos(s, d), A.segments(s, d), A.frames(s, d), A.channels(s, d), status="indexed").select(
        *VIDEO_COLS, "segment_count", "frame_count", "channel_name"),
    "video_detail": lambda s, d: L.video_detail(
        A.table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang"), {"segments": (A.segments(s, d).select("video_id", "start_time", "text"), "start_time")},
    ).select("video_id", "section", "position", F.get_json_object("body", "$.text").alias("text")),
    "list_comments": lambda s, d: L.list_comments(A.comments(s, d), authors(s, d), sort="sentiment", number=2).select(
        "id", "video_id", "author_id", "like_count", "sentiment_score", "comment_count"),
    "list_audio_segments": lambda s, d: L.list_audio_segments(A.audio_windows(s, d), source="speech", min_music=0.2, number=2).select(
        "id", "video_id", "start_time", "music_probability"),
    "search_audio_events": lambda s, d: L.search_audio_events(A.audio_windows(s, d), "music").select("id", "video_id", "music_probability", "matched_tag"),
    "search_audio_events_tagged": lambda s, d: L.search_audio_events(A.audio_windows(s, d), "purchase").select("id", "video_id", "start_time", "matched_tag"),
    "list_nodes": lambda s, d: L.list_nodes(nodes(s, d), "Entity", number=2),
    "list_metric_points": lambda s, d: L.list_metric_points(A.metric_points(s, d), metric_type="purchase", skip=10).drop("is_active"),
    "sample_frames": lambda s, d: L.sample_frames(A.frames(s, d), 3, 20.0).select("id", "video_id", "timestamp", "pos"),
    "eligible_videos": lambda s, d: L.eligible_videos(A.videos(s, d), "2001-08-02").select("id", "view_count", "uploaded_at"),
    "admit_comments": lambda s, d: L.admit_comments(A.comments(s, d), min_likes=0, min_reply_likes=5).select("id", "author_id", "like_count"),
    "prune_authors": lambda s, d: L.prune_authors(authors(s, d), "2024-07-02"),
    "evaluation_history": lambda s, d: L.evaluation_history(A.feedback(s, d)).select("id", "feedback_type", "created_at"),
    "cap_per_video": lambda s, d: L.cap_per_video(A.segments(s, d), 20, ["start_time", "id"]).select("id", "video_id", "start_time"),
    "system_metrics": lambda s, d: G.system_metrics({
        "videos": A.videos(s, d), "feedback": A.feedback(s, d), "segments": A.segments(s, d), "frames": A.frames(s, d), "comments": A.comments(s, d)}),
    "feedback_stats": lambda s, d: G.feedback_stats(A.feedback(s, d)),
    "comment_stats": lambda s, d: G.comment_stats(A.comments(s, d)),
    "audio_summary": lambda s, d: G.audio_summary(A.audio_windows(s, d)),
    "audio_overview": lambda s, d: G.audio_overview(A.audio_windows(s, d)),
    "top_authors": lambda s, d: G.top_authors(L.prune_authors(authors(s, d), "2024-07-02")).drop("last_seen_at", "is_pruned"),
    "top_entities": lambda s, d: G.top_entities(G.entity_counts(mention_rows(s, d)), 20, "person"),
    "graph_stats": lambda s, d: G.graph_stats(nodes(s, d), graph_edges(s, d)),
    "recrawl_stats": lambda s, d: G.recrawl_stats(recrawl_events(s, d)),
    "author_profiles": lambda s, d: G.author_profiles(A.comments(s, d)).select(
        "author_id", "comment_count", *[F.col("sentiment_distribution")[k].alias(k) for k in ("positive", "negative", "neutral")],
        F.array_join(F.transform(F.map_entries("topic_frequency"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("topics")),
    "entity_counts": lambda s, d: G.entity_counts(mention_rows(s, d)),
    "chart_data": lambda s, d: G.chart_data(A.metric_points(s, d), ["view", "click", "purchase"], "2024-01-05", "2024-01-28", "day", 15),
    "chart_data_weekly": lambda s, d: G.chart_data(A.metric_points(s, d), ["signup", "error"], "2024-01-01", "2024-02-01", "week", 100, {"is_active": True}),
    "datapoint_stats": lambda s, d: G.datapoint_stats(A.metric_points(s, d)),
    "topic_counts": lambda s, d: G.topic_counts(A.comments(s, d).select(
        F.explode("topic_labels").alias("topic_id"), F.lit("comment").alias("source_type"), F.col("id").alias("source_id")),
        A.comments(s, d).select(F.col("id").alias("source_id"), "channel_id")),
}

AUTH = "auth AS (SELECT author_id, count(*) AS comment_count, max(timestamp_posted) AS last_seen_at FROM comments GROUP BY 1)"
NODES = """nodes AS (SELECT 'c' || c_custkey AS id, 'CommentAuthor' AS node_type FROM customer UNION ALL SELECT 's' || s_suppkey, 'Channel' FROM supplier
   UNION ALL SELECT 'p' || p_partkey, 'Entity' FROM part UNION ALL SELECT 'n' || n_nationkey, 'Topic' FROM nation)"""
EDGES = """edges AS (SELECT 'c' || o_custkey AS source, 's' || l_suppkey AS target, 'ENGAGED_WITH' AS edge_type, CAST(count(*) AS DOUBLE) AS weight
   FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2 UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'MENTIONS', 1.0::DOUBLE FROM lineitem
   UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'COVERS', 1.0::DOUBLE FROM supplier)"""
MENT = f"""ment AS (SELECT lower(trim(w)) AS canonical_name, CASE WHEN length(w)%2=0 THEN 'person' ELSE 'organization' END AS entity_type, timestamp_posted AS ts,
   video_id, id FROM (SELECT *, unnest(list_distinct(list_filter({raw_words('text')}, lambda q: length(q)>=8))) AS w FROM comments) WHERE length(trim(w))>=2)"""
EC = """ec AS (SELECT canonical_name, entity_type, count(*) AS mention_count, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM ment GROUP BY 1,2
   HAVING count(*)>=2)"""


def longform(pairs: list[tuple[str, str]], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM {source}" for m, e in pairs)


UP, DOWN = "count(*) FILTER (WHERE feedback_type='upvote')", "count(*) FILTER (WHERE feedback_type='downvote')"
RECRAWL = """rc AS (SELECT o_orderkey AS id, o_orderpriority AS trigger, o_custkey AS video_id, o_orderdate AS recrawled_at,
   CASE WHEN o_orderkey%2=0 THEN ['title','view_count'] ELSE ['description'] END AS fields_changed, o_orderkey%7 AS ca, o_orderkey%3 AS cd FROM orders)"""


def chart(types, start, end, unit, n, extra=""):
    return sql("metric_points", f"""SELECT metric_type, bucket, count, average FROM (SELECT metric_type, CAST(date_trunc('{unit}', timestamp) AS TIMESTAMP) AS bucket,
      count(*) AS count, {r('avg(value)', 4)} AS average FROM metric_points WHERE metric_type IN {types} AND timestamp>='{start}' AND timestamp<'{end}' {extra}
      GROUP BY 1,2) QUALIFY row_number() OVER (PARTITION BY metric_type ORDER BY bucket DESC)<={n}""")


ORACLE = {
    "search_filter": sql("videos", """SELECT id, channel_id, platform, title, view_count, uploaded_at FROM videos WHERE language='en' AND platform='youtube'
        AND list_has_any(tags, ['1-URGENT','F']) AND duration_seconds BETWEEN 100 AND 15000 AND view_count BETWEEN 5000 AND 400000
        AND uploaded_at>='1996-01-01' AND uploaded_at<='2000-12-31'"""),
    "list_videos": sql("videos segments frames channels", """SELECT v.id, v.channel_id, platform, title, view_count, uploaded_at,
        (SELECT count(*) FROM segments s WHERE s.video_id=v.id) AS segment_count, (SELECT count(*) FROM frames f WHERE f.video_id=v.id) AS frame_count,
        c.name AS channel_name FROM (SELECT * FROM videos WHERE status='indexed' ORDER BY uploaded_at DESC, id LIMIT 50) v LEFT JOIN channels c ON c.id=v.channel_id"""),
    "video_detail": sql("segments", """SELECT doc_id AS video_id, 'video' AS section, 0.0::DOUBLE AS position, NULL AS text FROM documents
        UNION ALL SELECT video_id, 'segments', start_time, text FROM segments"""),
    "list_comments": sql("comments", """SELECT id, video_id, author_id, like_count, sentiment_score, comment_count FROM (SELECT * FROM comments
        WHERE status IN ('processed','pending') ORDER BY sentiment_score DESC, id LIMIT 50 OFFSET 50) JOIN auth USING (author_id)""", AUTH),
    "list_audio_segments": sql("audio_windows", """SELECT id, video_id, start_time, music_probability FROM audio_windows WHERE dominant_source='speech'
        AND music_probability>=0.2 ORDER BY start_time, id LIMIT 100 OFFSET 100"""),
    "search_audio_events": sql("audio_windows", """SELECT id, video_id, music_probability, lower(tag)='music' AND music_probability>=0.3 AS matched_tag
        FROM audio_windows WHERE dominant_source='music' ORDER BY music_probability DESC, video_id, id LIMIT 50"""),
    "search_audio_events_tagged": sql("audio_windows", """SELECT id, video_id, start_time, true AS matched_tag
        FROM audio_windows WHERE tag='purchase' AND music_probability>=0.3 ORDER BY start_time, video_id, id LIMIT 50"""),
    "list_nodes": f"WITH {NODES} SELECT * FROM nodes WHERE node_type='Entity' ORDER BY id LIMIT 50 OFFSET 50",
    "list_metric_points": sql("metric_points", """SELECT id, timestamp, source, metric_type, value FROM metric_points WHERE metric_type='purchase'
        ORDER BY timestamp DESC, id LIMIT 100 OFFSET 10"""),
    "sample_frames": sql("frames", """SELECT id, video_id, timestamp, pos FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, id)-1 AS pos
        FROM frames) WHERE pos%3=0 AND (blur_score>=20 OR is_scene_change)"""),
    "eligible_videos": sql("videos", """SELECT id, view_count, uploaded_at FROM videos WHERE duration_seconds BETWEEN 30 AND 14400 AND view_count>=100
        AND uploaded_at>=TIMESTAMP '2001-08-02' - INTERVAL 365 DAY"""),
    "admit_comments": sql("comments", r"""SELECT id, author_id, like_count FROM comments WHERE like_count>=CASE WHEN parent_comment_id IS NULL THEN 0 ELSE 5 END
        AND (length(text)-length(replace(text,'http','')))//4<=3 AND length(regexp_replace(text,'[^\p{Lu}]','','g'))/greatest(length(text),1)<=0.7
        QUALIFY row_number() OVER (PARTITION BY author_id, lower(trim(text)) ORDER BY timestamp_posted, id)=1"""),
    "prune_authors": sql("comments", "SELECT *, last_seen_at < TIMESTAMP '2024-07-02' - INTERVAL 180 DAY AS is_pruned FROM auth", AUTH),
    "evaluation_history": sql("feedback", "SELECT id, feedback_type, created_at FROM feedback ORDER BY created_at DESC, id LIMIT 50"),
    "cap_per_video": sql("segments", "SELECT id, video_id, start_time FROM segments QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY start_time, id)<=20"),
    "system_metrics": sql("videos feedback segments frames comments", " UNION ALL ".join([
        longform([("total_videos", "count(*)"), *[(f"{x}_videos", f"count(*) FILTER (WHERE status='{x}')") for x in ("indexed", "queued", "failed")]], "videos"),
        longform([("total_feedback", "count(*)"), ("upvote_ratio", r(f"{UP}/greatest({UP}+{DOWN},1)", 4))], "feedback"),
        *[longform([(f"total_{t}", "count(*)")], t) for t in ("segments", "frames", "comments")]])),
    "feedback_stats": sql("feedback", f"""SELECT count(*) AS total, {UP} AS upvotes, {DOWN} AS downvotes,
        count(*) FILTER (WHERE feedback_type='timestamp_correction') AS timestamp_corrections,
        count(*) FILTER (WHERE feedback_type='mismatch_report') AS mismatch_reports, {r(f'{UP}/greatest({UP}+{DOWN},1)', 4)} AS upvote_ratio FROM feedback"""),
    "comment_stats": sql("comments", f"""SELECT count(*) AS total, {', '.join(f"count(*) FILTER (WHERE status='{x}') AS {x}" for x in ('processed', 'pending', 'spam', 'toxic'))},
        {r('avg(depth_level)', 2)} AS avg_depth, max(depth_level) AS max_depth, {r("count(*) FILTER (WHERE status='spam')/count(*)", 4)} AS spam_rate FROM comments"""),
    "audio_summary": sql("audio_windows", f"""SELECT video_id, count(*) AS total_windows, {r('sum(end_time-start_time)', 2)} AS duration_seconds,
        {r('avg(bpm)', 1)} AS global_bpm, {', '.join(f"{r(f'coalesce(sum(end_time-start_time) FILTER (WHERE dominant_source={chr(39)}{x}{chr(39)}),0)', 2)} AS total_{x}_seconds" for x in ('music', 'speech', 'silence'))},
        any_value(src) AS dominant_source, any_value(k) AS global_key, CASE WHEN avg(overall_manipulation)>0.1 THEN {r('avg(overall_manipulation)', 3)} END AS manipulation_summary
        FROM audio_windows LEFT JOIN src USING (video_id) LEFT JOIN ky USING (video_id) GROUP BY 1""",
        f"""src AS (SELECT video_id, dominant_source AS src FROM (SELECT video_id, dominant_source, {r('sum(end_time-start_time)', 3)} AS s FROM audio_windows GROUP BY 1,2)
          QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY s DESC, dominant_source)=1)""",
        """ky AS (SELECT video_id, musical_key AS k FROM audio_windows WHERE musical_key IS NOT NULL GROUP BY 1,2
          QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY count(*) DESC, musical_key)=1)"""),
    "audio_overview": sql("audio_windows", f"""SELECT count(*) AS total_segments, count(DISTINCT video_id) AS videos, {r('avg(music_probability)', 3)} AS avg_music,
        {r('avg(speech_probability)', 3)} AS avg_speech, count(*) FILTER (WHERE overall_manipulation>0.4) AS manipulated FROM audio_windows"""),
    "top_authors": sql("comments", """SELECT author_id, comment_count FROM auth WHERE NOT last_seen_at < TIMESTAMP '2024-07-02' - INTERVAL 180 DAY
        ORDER BY comment_count DESC, author_id LIMIT 20""", AUTH),
    "top_entities": sql("comments", "SELECT * FROM ec WHERE entity_type='person' ORDER BY mention_count DESC, canonical_name LIMIT 20", MENT, EC),
    "graph_stats": f"""WITH {NODES}, {EDGES} SELECT 'nodes' AS part, coalesce(node_type,'total') AS type, count(*) AS n FROM nodes GROUP BY ROLLUP(node_type)
        UNION ALL SELECT 'edges', coalesce(edge_type,'total'), count(*) FROM edges GROUP BY ROLLUP(edge_type)""",
    "recrawl_stats": f"""WITH {RECRAWL} SELECT 'total' AS metric, CAST(count(*) AS DOUBLE) AS value FROM rc
        UNION ALL SELECT 'avg_comments_added', {r('avg(ca)', 1)} FROM rc UNION ALL SELECT 'avg_comments_deleted', {r('avg(cd)', 1)} FROM rc
        UNION ALL SELECT 'title_changes', count(*) FILTER (WHERE id%2=0) FROM rc UNION ALL SELECT 'description_changes', count(*) FILTER (WHERE id%2=1) FROM rc
        UNION ALL SELECT 'trigger:' || trigger, count(*) FROM rc GROUP BY trigger
        UNION ALL SELECT 'field:' || f, count(*) FROM (SELECT unnest(fields_changed) AS f FROM rc) GROUP BY f""",
    "author_profiles": sql("comments", f"""SELECT author_id, count(*) AS comment_count,
        {', '.join(f"count(*) FILTER (WHERE coalesce(sentiment_label,'neutral')='{x}') AS {x}" for x in ('positive', 'negative', 'neutral'))}, any_value(tp) AS topics
        FROM comments LEFT JOIN (SELECT author_id, string_agg(t || ':' || n, ',' ORDER BY t) AS tp FROM (SELECT author_id, t, count(*) AS n FROM (
          SELECT author_id, unnest(topic_labels) AS t FROM comments WHERE status='processed') GROUP BY 1,2) GROUP BY 1) USING (author_id) WHERE status='processed' GROUP BY 1"""),
    "entity_counts": sql("comments", "SELECT * FROM ec", MENT, EC),
    "chart_data": chart("('view','click','purchase')", "2024-01-05", "2024-01-28", "day", 15),
    "chart_data_weekly": chart("('signup','error')", "2024-01-01", "2024-02-01", "week", 100, "AND is_active"),
    "datapoint_stats": sql("metric_points", f"""SELECT count(*) AS total_points, count(DISTINCT source) FILTER (WHERE is_active) AS active_sources,
        {r('count(*) FILTER (WHERE is_active)/count(*)*100', 2)} AS success_rate FROM metric_points"""),
    "topic_counts": sql("comments", """SELECT topic_id, 'comment' AS source_type, channel_id, count(*) AS mentions FROM (SELECT unnest(topic_labels) AS topic_id, channel_id
        FROM comments) GROUP BY 1,3"""),
}
