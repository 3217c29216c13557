"""Natural-language search over several kinds of evidence, many queries at once."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.numbers import rnd, total
from ..functions.urls import timecoded_url
from ..session import cut_lineage
from .joins import nearest_distance, within
from .ordered import time_bucket, top_n_per_key, with_neighbours

MODALITIES = list(L.FUSION_WEIGHTS)
KEY = ["query_id", "video_id", "bucket"]
#: Found keys are broadcast up to so many.
FOUND_KEYS = 1_000_000


# ---- query understanding -----------------------------------------------------------------

def _first_match(text: Column, patterns) -> Column:
    out = F.lit(None).cast("string")
    for pattern, label in reversed(patterns):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def decompose_query(queries: DataFrame, text: str = "text") -> DataFrame:
    """Numbers, actions, emotion, era, context, objects and keywords of every query row."""
    low = F.lower(F.trim(text))
    def lit_array(values):
        return F.array(*[F.lit(v) for v in values])
    q = queries.withColumn("_low", low).withColumn(
        "_words", F.array_distinct(F.regexp_extract_all("_low", F.lit(r"(?U)\b\w+\b"), F.lit(0))))
    q = q.withColumn("numbers", F.regexp_extract_all("_low", F.lit(L.NUMBER_PATTERN), F.lit(0)))
    plain = F.regexp_extract_all("_low", F.lit(r"\b\d+\b"), F.lit(0))
    known = lit_array(L.ACTION_WORDS + L.EMOTION_WORDS + L.QUERY_STOPWORDS)
    q = q.withColumns({
        "emotion": F.array_min(F.array_intersect("_words", lit_array(L.EMOTION_WORDS))),
        "actions": F.array_sort(F.array_intersect("_words", lit_array(L.ACTION_WORDS))),
        "time_era": _first_match(F.col("_low"), L.ERA_PATTERNS), "context": _first_match(F.col("_low"), L.CONTEXT_PATTERNS),
        "objects": F.array_sort(F.array_except(F.array_except("_words", known), plain))})
    keywords = F.array_sort(F.array_distinct(F.concat("objects", "actions", "numbers")))
    return q.withColumn("keywords", keywords).drop("_low", "_words")


def sub_queries(decomposed: DataFrame, text: str = "text") -> DataFrame:
    def joined(c):
        return F.when(F.size(c) > 0, F.array_join(c, " "))
    return decomposed.select(
        "query_id", F.col(text).alias("semantic"), F.array_join("keywords", " ").alias("keyword"), joined("numbers").alias("ocr"),
        joined("objects").alias("visual"), F.col("emotion"))


# ---- fusion ------------------------------------------------------------------------------

def hit_key(ts: Column) -> Column:
    return (F.floor(ts / 10) * 10).cast("long")


def fuse_hits(text_hits: DataFrame, visual_hits: DataFrame, decomposed: DataFrame) -> DataFrame:
    """One row per query, video and ten seconds with the best hit of each kind.

    text_hits: query_id, video_id, timestamp, end_time, score, text, ocr_text, confidence. visual_hits: query_id,
    video_id, timestamp, score, visual_tags.
    """
    t = text_hits.select(
        "query_id", "video_id", hit_key(F.col("timestamp")).alias("bucket"),
        F.struct("score", (-F.col("timestamp")).alias("o"), "timestamp", "end_time", "text", "ocr_text", "confidence").alias("t"),
        F.lit(None).cast("struct<score:double,o:double,timestamp:double,visual_tags:array<string>>").alias("v"))
    v = visual_hits.select(
        "query_id", "video_id", hit_key(F.col("timestamp")).alias("bucket"), F.lit(None).cast(t.schema["t"].dataType).alias("t"),
        F.struct("score", (-F.col("timestamp")).alias("o"), "timestamp", "visual_tags").alias("v"))
    g = t.unionByName(v).groupBy(*KEY).agg(F.max("t").alias("t"), F.max("v").alias("v"))
    g = g.join(decomposed.select("query_id", "keywords", "numbers"), "query_id", "left")
    low = F.lower(F.coalesce("t.text", F.lit("")))
    g = g.withColumn("_low", low).withColumn("_ocr", F.coalesce("t.ocr_text", F.lit("")))
    kw = F.size(F.filter("keywords", lambda k: F.contains(F.col("_low"), k))) / F.greatest(F.size("keywords"), F.lit(1))
    nums = F.size(F.filter("numbers", lambda k: F.contains(F.col("_ocr"), k))) / F.greatest(F.size("numbers"), F.lit(1))
    has_text = F.col("t").isNotNull()
    return g.select(
        *KEY, F.coalesce("t.timestamp", "v.timestamp").alias("timestamp"), F.col("t.end_time").alias("end_timestamp"),
        F.coalesce("t.score", F.lit(0.0)).alias("text_semantic"), F.coalesce("v.score", F.lit(0.0)).alias("visual_similarity"),
        F.when(has_text & (F.size("numbers") > 0) & (F.col("_ocr") != ""), F.least(nums, F.lit(1.0))).otherwise(0.0).alias("ocr_match"),
        F.when(has_text & (F.size("keywords") > 0), F.least(kw, F.lit(1.0))).otherwise(0.0).alias("keyword_match"),
        F.lit(0.0).alias("emotion_context"), F.coalesce("t.text", F.lit("")).alias("transcript"), F.col("_ocr").alias("ocr_text"),
        F.coalesce("v.visual_tags", F.array().cast("array<string>")).alias("visual_tags"), F.coalesce("t.confidence", F.lit(0.5)).alias("confidence"))


def add_comment_scores(entries: DataFrame, comment_hits: DataFrame) -> DataFrame:
    """comment_hits: query_id, video_id, id, score, sentiment_score, author_id, ts_seconds."""
    g = comment_hits.groupBy("query_id", "video_id").agg(
        F.max(F.struct("score", (-F.col("id")).alias("o"), F.coalesce("ts_seconds", F.array().cast("array<double>")).alias("ts"))).alias("best"),
        F.count(F.lit(1)).alias("n"), F.var_samp(F.coalesce("sentiment_score", F.lit(0.0))).alias("var"), F.count_distinct("author_id").alias("authors"))
    j = entries.join(g, ["query_id", "video_id"], "left")
    close = F.exists("best.ts", lambda s: F.abs(s - F.col("timestamp")) < 30)
    return j.withColumns({
        "comment_semantic": F.coalesce("best.score", F.lit(0.0)),
        "comment_timestamp_boost": F.when((F.col("timestamp") > 0) & close, 0.8).otherwise(0.0),
        "agreement_cluster": F.when(F.col("n") >= 3, F.greatest(F.lit(0.0), 1 - 2 * F.col("var"))).otherwise(0.0),
        "user_cluster_confidence": F.when(F.col("authors") >= 5, F.least(F.col("authors") / 20, F.lit(1.0))).otherwise(0.0),
    }).drop("best", "n", "var", "authors")


def add_entity_overlap(entries: DataFrame, query_entities: DataFrame, video_entities: DataFrame) -> DataFrame:
    """query_entities(query_id, entity), video_entities(video_id, entity): share of the query's entities the video mentions.

    Only pairs of query and video with an entry are looked up, not every query with all videos that share a name with it.
    """
    q = query_entities.distinct()
    size = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    asked = entries.select("query_id", "video_id").distinct().join(q, "query_id")
    hit = asked.join(video_entities.distinct(), ["video_id", "entity"]).groupBy("query_id", "video_id").agg(F.count(F.lit(1)).alias("m"))
    share = hit.join(size, "query_id").select("query_id", "video_id", (F.col("m") / F.col("n")).alias("entity_overlap"))
    return entries.join(share, ["query_id", "video_id"], "left").withColumn("entity_overlap", F.coalesce("entity_overlap", F.lit(0.0)))


def query_entities(queries: DataFrame, entities: DataFrame, text: str = "text") -> DataFrame:
    """Dictionary entities contained in the lower-cased query.

    Names are joined on their first three characters with the three-character pieces of the query (shorter names on
    shorter pieces) and then searched for whole, so neither table is broadcast and names of any length are found.
    """
    low = queries.select("query_id", F.lower(F.col(text)).alias("low")).filter("low is not null and low <> ''")
    pieces = [F.transform(F.sequence(F.lit(1), F.length("low")), _piece(n)) for n in (1, 2, 3)]
    q = low.withColumn("head", F.explode(F.array_distinct(F.concat(*pieces))))
    names = entities.select(F.col("canonical_name").alias("entity")).filter("entity <> ''").distinct().withColumn("head", F.substring("entity", 1, 3))
    return q.join(names, "head").filter(F.contains(F.col("low"), F.col("entity"))).select("query_id", "entity").distinct()


def _piece(n: int):
    return lambda i: F.substring(F.col("low"), i, F.lit(n))


def near_audio(entries: DataFrame, audio: DataFrame) -> DataFrame:
    """Audio windows around each hit, or the first three of the video when there are none."""
    fields = ["event_labels", "dominant_source", "bpm", "loudness_lufs", "harmonic_ratio", "overall_manipulation"]
    a = audio.select("video_id", "id", F.col("start_time").alias("_s"), F.col("end_time").alias("_e"), *fields)
    hits = entries.select(*KEY, "timestamp")
    near = cut_lineage(within(hits, a, "video_id", "timestamp", "_s", "_e", 5.0, 10.0, 30.0).select(*KEY, *fields))
    lone = hits.join(near.select(*KEY).distinct(), KEY, "left_anti")
    first = top_n_per_key(a, "video_id", [F.asc("_s"), F.asc("id")], 3).select("video_id", *fields)
    return near.unionByName(lone.join(first, "video_id").select(*KEY, *fields))


def add_audio_scores(entries: DataFrame, audio: DataFrame, decomposed: DataFrame, text: str = "text") -> DataFrame:
    q = decomposed.select("query_id", F.transform(F.array_distinct(F.concat("objects", "actions")), lambda x: F.lower(x)).alias("kw"), F.lower(text).alias("low"))
    n = near_audio(entries, audio).join(q, "query_id")
    terms = F.array(*[F.lit(t) for t in L.ACOUSTIC_TERMS])
    labels = F.array_append(F.coalesce("event_labels", F.array().cast("array<string>")), F.coalesce("dominant_source", F.lit("")))
    event = F.size(F.array_intersect("kw", labels)) / F.greatest(F.size(F.array_intersect("kw", terms)), F.lit(1))

    def has(*names):
        return reduce(lambda a, b: a | b, [F.contains(F.col("low"), F.lit(x)) for x in names])

    loud, tone, odd = [F.coalesce(c, F.lit(d)) for c, d in (("loudness_lufs", -30.0), ("harmonic_ratio", 0.5), ("overall_manipulation", 0.0))]
    attr = total([
        F.when(has("fast", "upbeat") & (F.col("bpm") > 120), 0.4).when(has("slow", "dramatic") & (F.col("bpm") < 80), 0.4).otherwise(0.0),
        F.when(has("loud", "bass") & (loud > -15), 0.3).when(has("quiet", "soft") & (loud < -25), 0.3).otherwise(0.0),
        F.when(has("music") & (tone > 0.6), 0.3).otherwise(0.0), F.when(has("robotic", "autotune", "speed", "pitch", "filter") & (odd > 0.3), 0.4).otherwise(0.0)])
    best = n.groupBy(*KEY).agg(F.least(F.max(event), F.lit(1.0)).alias("audio_event_match"), F.least(F.max(attr), F.lit(1.0)).alias("audio_attribute_match"))
    return entries.join(best, KEY, "left").fillna(0.0, ["audio_event_match", "audio_attribute_match"])


def add_alignment(entries: DataFrame, alignments: DataFrame) -> DataFrame:
    a = alignments.select("video_id", F.col("start_time").alias("_s"), F.col("end_time").alias("_e"), "alignment_score")
    best = within(entries.select(*KEY, "timestamp"), a, "video_id", "timestamp", "_s", "_e", 5.0, 15.0, 30.0).groupBy(*KEY).agg(
        F.greatest(F.max("alignment_score"), F.lit(0.0)).alias("alignment_quality"))
    return entries.join(best, KEY, "left").fillna(0.0, ["alignment_quality"])


def add_change_points(entries: DataFrame, points: DataFrame, min_magnitude: float = 0.3, reach: float = 10.0) -> DataFrame:
    p = points.filter(F.col("magnitude") >= min_magnitude).select("video_id", F.col("timestamp").alias("_p"))
    d = nearest_distance(entries, p, "video_id", "timestamp", "_p", reach, KEY)
    return entries.join(d, KEY, "left").withColumn(
        "change_point_proximity", F.coalesce(1 - F.col("distance") / reach, F.lit(0.0))).drop("distance")


def final_score(entries: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum times confidence, then the bonus for matching neighbours within 30 s."""
    w = weights or L.FUSION_WEIGHTS
    base = total([F.col(m) * w.get(m, 0.0) for m in MODALITIES if m != "temporal_coherence"]) * (0.7 + 0.3 * F.col("confidence"))
    e = entries.withColumn("_base", base)
    e = with_neighbours(e, ["query_id", "video_id"], ["timestamp", "bucket"], time_bucket("timestamp", 600), ["timestamp"], "_prev", "_next")
    t = F.col("timestamp")
    n = F.when(t - F.col("_prev.timestamp") < 30, 1).otherwise(0) + F.when(F.col("_next.timestamp") - t < 30, 1).otherwise(0)
    e = e.withColumn("temporal_coherence", F.least(n * 0.15, F.lit(0.3)))
    return e.withColumn("final_score", F.col("_base") + F.col("temporal_coherence") * w.get("temporal_coherence", 0.0)).drop("_base", "_prev", "_next")


def inclusion_threshold(entries: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Drop a hit only when every listed score is under its minimum."""
    t = thresholds or L.INCLUSION_THRESHOLDS
    return entries.filter(reduce(lambda a, b: a | b, [F.col(c) >= v for c, v in t.items()]))


def _found(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows whose key was found. A checked number of keys is broadcast, so other rows go into no further shuffle."""
    keys = found.select(key).distinct()
    return rows.join(F.broadcast(keys) if keys.count() <= FOUND_KEYS else keys, key, "left_semi")


def score_hits(queries: DataFrame, tables: dict[str, DataFrame], k: int = 200, weights: dict[str, float] | None = None, text: str = "text") -> DataFrame:
    """All scores of every hit of every query.

    queries: query_id, vector, text. tables: ``segments``, ``frames`` and ``comments`` with id, vector and their
    payload, ``audio``, ``alignments``, ``change_points``, ``entities``(canonical_name) and ``video_entities``.
    Rows and side tables are cut to what was found before they are joined; the hits and the fused hits are kept once for all of them.
    """
    from .vectors import vector_topk
    q = decompose_query(queries.drop("vector"), text)
    vec = queries.select("query_id", "vector")

    def best(name):
        hits = cut_lineage(vector_topk(tables[name], vec, k).drop("rank"))
        return hits.join(_found(tables[name].drop("vector"), hits, "id"), "id")

    e = fuse_hits(best("segments"), best("frames"), q)
    e = cut_lineage(add_comment_scores(e, best("comments")))
    audio, alignments, points, mentioned = [_found(tables[name], e, "video_id") for name in ("audio", "alignments", "change_points", "video_entities")]
    at = e.select(*KEY, "timestamp")
    extra = [add_audio_scores(at, audio, q, text), add_alignment(at, alignments), add_change_points(at, points)]
    e = add_entity_overlap(e, query_entities(queries, tables["entities"], text), mentioned)
    for side in extra:
        e = e.join(side.drop("timestamp"), KEY)
    return final_score(cut_lineage(e), weights)


def search(queries: DataFrame, tables: dict[str, DataFrame], filters: dict | None = None, page: int = 1, size: int = 20, k: int = 200,
           weights: dict[str, float] | None = None, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Result page of every query. Filters are applied before the vector scan, those on videos through a semi join."""
    from .filters import search_filter
    tables = dict(tables)
    for f in filters or {}:
        if not any(_applies(f, tables[name]) for name in ("segments", "frames", "comments", "videos")):
            raise ValueError(f"no table has the column of filter {f}")
    for name in ("segments", "frames", "comments"):
        here = {f: v for f, v in (filters or {}).items() if _applies(f, tables[name])}
        tables[name] = search_filter(tables[name], **here)
    on_video = {f: v for f, v in (filters or {}).items() if f != "min_confidence" and _applies(f, tables["videos"])}
    if on_video:
        ids = search_filter(tables["videos"], **on_video).select(F.col("id").alias("video_id"))
        for name in ("segments", "frames", "comments"):
            tables[name] = tables[name].join(ids, "video_id", "left_semi")
    hits = inclusion_threshold(score_hits(queries, tables, k, weights), thresholds)
    return hydrate(page_of_results(hits, page, size), tables["videos"], tables["channels"])


def _applies(name: str, df: DataFrame) -> bool:
    needs = {"language": "language", "min_confidence": "confidence", "channels": "channel_id", "platform": "platform", "tags": "tags", "min_duration": "duration_seconds",
             "max_duration": "duration_seconds", "min_views": "view_count", "max_views": "view_count", "uploaded_after": "uploaded_at", "uploaded_before": "uploaded_at", "modality": "modality"}
    return needs[name] in df.columns


def page_of_results(entries: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    ranked = top_n_per_key(entries, "query_id", [F.desc(rnd("final_score", 6)), F.asc("video_id"), F.asc("bucket")], page * size)
    return ranked.filter(F.col("rank") > (page - 1) * size)


def explanation() -> Column:
    """The sentences are result values and fixed."""
    said = F.concat_ws(
        " | ",
        F.when(F.col("text_semantic") > 0.3, F.format_string("Transcript semantically matches your query (score: %.2f)", rnd("text_semantic", 2))),
        F.when(F.col("keyword_match") > 0, "Keywords found in transcript"),
        F.when(F.col("visual_similarity") > 0.2, F.format_string("Visual content matches (score: %.2f)", rnd("visual_similarity", 2))),
        F.when(F.col("ocr_match") > 0, F.concat(F.lit("On-screen text/numbers match: '"), F.substring("ocr_text", 1, 50), F.lit("'"))),
        F.when(F.col("temporal_coherence") > 0, "Surrounding segments also match (temporal coherence)"))
    return F.when(said == "", "Partial match across multiple signals").otherwise(said)


def hydrate(entries: DataFrame, videos: DataFrame, channels: DataFrame) -> DataFrame:
    """Result rows with video and channel data; hits of unknown videos are dropped."""
    v = videos.select(F.col("id").alias("video_id"), F.col("title").alias("video_title"), "channel_id", F.col("url").alias("video_url"), "view_count")
    c = channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel_name"))
    j = entries.join(v, "video_id").join(c, "channel_id", "left")
    return j.select(
        "query_id", "rank", "video_id", "video_title", "channel_name", "timestamp", "end_timestamp", F.substring("transcript", 1, 300).alias("transcript_snippet"),
        F.slice("visual_tags", 1, 5).alias("visual_tags"), F.nullif("ocr_text", F.lit("")).alias("ocr_text"), rnd("final_score", 4).alias("confidence_score"),
        *[rnd(m, 4).alias(m) for m in MODALITIES], "video_url", "view_count", explanation().alias("explanation"),
        timecoded_url("video_url", "timestamp").alias("video_url_with_timecode"))


# ---- feedback ----------------------------------------------------------------------------

def recalibrate_weights(feedback: DataFrame, as_of: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(modality, weight) after the last week's votes; empty when there are fewer than ten."""
    names = ["text_semantic", "visual_similarity", "ocr_match", "keyword_match", "temporal_coherence", "emotion_context"]
    base = {m: (weights or L.FUSION_WEIGHTS)[m] for m in names}
    top = max(base, key=base.get)
    recent = F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr("interval 7 days")
    up, down = [F.count_if(F.col("feedback_type") == t) for t in ("upvote", "downvote")]
    s = feedback.agg(F.count_if(recent).alias("recent"), (up / F.greatest(up + down, F.lit(1))).alias("ratio")).filter("recent >= 10")
    low = F.col("ratio") < 0.6
    moved = {m: F.when(low, F.greatest(F.lit(w - 0.02), F.lit(0.05)) if m == top else F.least(F.lit(w + 0.005), F.lit(0.5))).otherwise(F.lit(w)) for m, w in base.items()}
    scale = F.greatest(total(list(moved.values())), F.lit(1e-8))
    rows = F.array(*[F.struct(F.lit(m).alias("modality"), rnd(c / scale, 4).alias("weight")) for m, c in moved.items()])
    return s.select(F.explode(rows).alias("r")).select("r.*")


def precision_at_k(results: DataFrame, feedback: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """results(query_text, video_id, score): mean share of the first k results with an upvote."""
    liked = feedback.filter("feedback_type = 'upvote'").select("query_text", "video_id").distinct().withColumn("_up", F.lit(1))
    ranked = top_n_per_key(results, "query_text", [F.desc("score"), F.asc("video_id")], max(ks)).join(liked, ["query_text", "video_id"], "left")
    per = ranked.groupBy("query_text").agg(*[(F.sum(F.when((F.col("rank") <= k), F.coalesce("_up", F.lit(0)))) / k).alias(f"p{k}") for k in ks])
    return per.agg(*[rnd(F.avg(f"p{k}"), 4).alias(f"precision_at_{k}") for k in ks])


