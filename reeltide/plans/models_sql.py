"""The adapters once more as plain SQL, for checking results with another engine."""
from __future__ import annotations


def r(expr: str, digits: int) -> str:
    return f"(floor(({expr})*1e{digits}+0.500001)/1e{digits})"


def clip(expr: str, low=0, high=1) -> str:
    return f"CASE WHEN ({expr}) IS NOT NULL THEN greatest({float(low)}::DOUBLE, least({float(high)}::DOUBLE, {expr})) END"


def words(expr: str) -> str:
    return rf"list_filter(string_split_regex(lower({expr}), '\s+'), lambda w: w <> '')"


def raw_words(expr: str) -> str:
    return rf"list_filter(string_split_regex({expr}, '\s+'), lambda w: w <> '')"


def in_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


MODELS = {
    "comments": """
      SELECT conv_id*100+turn AS id, conv_id*100 AS root_thread_id,
        CASE WHEN turn>0 THEN conv_id*100 + CASE WHEN conv_id%2=1 THEN turn-1 ELSE (turn-1)//2 END END AS parent_comment_id,
        CAST(CASE WHEN conv_id%2=1 THEN turn ELSE floor(log2(turn+1)+1e-9) END AS BIGINT) AS depth_level,
        role || '_' || ((conv_id+turn)%7) AS author_id, conv_id%10 AS video_id, conv_id%4 AS channel_id,
        make_timestamp((1704067200 + conv_id*3600 + turn*60)*1000000) AS timestamp_posted,
        ((conv_id*31+turn*17)%21-10)/10 AS sentiment_score,
        CASE WHEN turn%7=6 THEN NULL WHEN ((conv_id*31+turn*17)%21-10)/10 > 0.2 THEN 'positive'
             WHEN ((conv_id*31+turn*17)%21-10)/10 < -0.2 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
        CASE WHEN turn%6<>5 THEN ((conv_id*13+turn*7)%11)/10 END AS toxicity_score,
        (conv_id*turn)%150 AS like_count,
        CASE WHEN (conv_id+turn)%9=0 THEN 'pending' WHEN (conv_id+turn)%9=1 THEN 'spam' ELSE 'processed' END AS status,
        CASE turn%5 WHEN 0 THEN ['technology'] WHEN 1 THEN ['science','gaming'] WHEN 3 THEN ['music'] WHEN 4 THEN ['gaming']
             ELSE CAST([] AS VARCHAR[]) END AS topic_labels, text
      FROM conversations""",
    "videos": """
      SELECT o_orderkey AS id, o_custkey AS channel_id,
        CASE o_orderkey%3 WHEN 0 THEN 'youtube' WHEN 1 THEN 'twitch' ELSE 'vimeo' END AS platform,
        'Video ' || o_orderpriority AS title, 'https://www.youtube.com/watch?v=' || o_orderkey AS url,
        o_orderkey%20000 AS duration_seconds, CAST(floor(o_totalprice) AS BIGINT) AS view_count,
        CAST(floor(o_totalprice/100) AS BIGINT) AS like_count, CASE WHEN o_orderkey%2=0 THEN 'en' ELSE 'fr' END AS language,
        o_orderdate AS uploaded_at, CASE o_orderstatus WHEN 'F' THEN 'indexed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status,
        [o_orderpriority, o_orderstatus] AS tags, o_orderkey%2=0 AS has_captions, o_totalprice%100 AS priority_score,
        o_orderdate AS last_crawled_at
      FROM orders""",
    "channels": """
      SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS country, CAST(floor(c_acctbal) AS BIGINT) AS subscriber_count,
        CAST(c_nationkey%5+1 AS BIGINT) AS priority_tier, c_custkey%2=0 AS is_active,
        make_timestamp((946684800 + c_custkey*40000)*1000000) AS last_crawled_at FROM customer""",
    "uploads": "SELECT o_custkey AS channel_id, o_orderkey AS video_id, o_orderdate AS ts FROM orders",
    "dense_uploads": "SELECT user_id AS channel_id, event_id AS video_id, ts FROM events",
    "timeline": """
      SELECT *, floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id))/600000.0)/1000.0 AS start_time,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events""",
    "audio_windows": """
      SELECT event_id AS id, user_id AS video_id, start_time,
        coalesce(lead(start_time) OVER (PARTITION BY user_id ORDER BY start_time, event_id), start_time+5.0) AS end_time,
        (value%100)/100 AS music_probability, 1-(value%100)/100 AS speech_probability,
        CASE WHEN k%10<>9 THEN -(value%60) END AS loudness_lufs, 500+value*10 AS spectral_centroid, (k%100)/100 AS harmonic_ratio,
        CASE event_type WHEN 'view' THEN 'speech' WHEN 'click' THEN 'music' WHEN 'error' THEN 'silence' ELSE 'noise' END AS dominant_source,
        event_type AS tag, 60+value AS bpm, CASE WHEN k%5<>0 THEN 'K' || (k%12) END AS musical_key,
        (k%50)/100 AS overall_manipulation, (k%20)/100 AS zero_crossing_rate, value%20 AS dynamic_range_db
      FROM timeline""",
    "frames": """
      SELECT event_id AS id, user_id AS video_id, start_time AS timestamp, k%3=0 AS is_scene_change,
        CAST(floor(value%20) AS INT) AS tag_count, event_type || ' ' || k AS ocr_text,
        CASE WHEN k%7<>0 THEN (value%100)/100 END AS ocr_confidence, value AS blur_score, k%4 AS face_count, (k%10)/10 AS face_area
      FROM timeline""",
    "segments": r"""
      SELECT doc_id*100000+i AS id, doc_id AS video_id, source AS channel_id, i*5.0::DOUBLE AS start_time, i*5.0::DOUBLE+5.0 AS end_time,
        t AS text, lang AS language, ((doc_id+i)%10)/10 AS confidence, ((doc_id*7+i*5)%21-10)/10 AS sentiment
      FROM (SELECT doc_id, lang, source, i, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS t FROM (
              SELECT doc_id, lang, source, unnest(string_split(text, '.')) AS raw,
                     generate_subscripts(string_split(text, '.'), 1)-1 AS i FROM documents))
      WHERE t <> ''""",
    "mentions": """
      SELECT l_partkey AS entity_id, l_orderkey AS source_id, l_suppkey AS channel_id, l_linenumber AS position, l_shipdate AS ts,
        o_custkey AS author_id FROM lineitem JOIN orders ON l_orderkey=o_orderkey""",
    "author_channels": "SELECT DISTINCT author_id, entity_id AS video_id, channel_id FROM mentions",
    "feedback": """
      SELECT event_id AS id, user_id AS video_id, 'q' || (event_id%10) AS query_text,
        CASE event_type WHEN 'click' THEN 'upvote' WHEN 'error' THEN 'mismatch_report' WHEN 'view' THEN 'downvote'
             ELSE 'timestamp_correction' END AS feedback_type, ts AS created_at FROM events""",
    "metric_points": """
      SELECT event_id AS id, ts AS timestamp, CAST(user_id AS VARCHAR) AS source, event_type AS metric_type, value, event_id%3<>0 AS is_active
      FROM events""",
    "snap_old": """
      SELECT p_partkey AS platform_id, p_name AS title, CAST(floor(p_retailprice) AS BIGINT) AS like_count, p_brand AS description,
        CAST(p_size AS BIGINT) AS view_count FROM part""",
    "snap_new": """
      SELECT p_partkey AS platform_id, CASE WHEN p_partkey%11=0 THEN upper(p_name) WHEN p_partkey%17=0 THEN NULL ELSE p_name END AS title,
        CAST(floor(p_retailprice) AS BIGINT) + CASE WHEN p_partkey%7=0 THEN 1 ELSE 0 END AS like_count, p_brand AS description,
        CAST(p_size AS BIGINT) AS view_count FROM part WHERE p_partkey%13<>0""",
    "calibration_samples": """
      SELECT t.target, least(n_chars/4000,1.0) AS raw, CASE WHEN t.target='ocr.confidence' THEN toxic ELSE quality END AS truth
      FROM labels JOIN documents USING (doc_id)
      CROSS JOIN (VALUES ('audio.pitch_shift'),('ocr.confidence'),('clip.label_confidence')) t(target)""",
    "vectors": "SELECT vec_id AS id, embedding AS vector, label AS collection FROM embeddings",
}
# models that read another one
NEEDS = {"audio_windows": ["timeline"], "frames": ["timeline"], "author_channels": ["mentions"]}


def sql(models: str, body: str, *ctes: str) -> str:
    """A query over the named models; ``ctes`` are further ``name AS (...)`` items."""
    names: list[str] = []
    for m in models.split():
        for dep in NEEDS.get(m, []):
            if dep not in names:
                names.append(dep)
        if m not in names:
            names.append(m)
    items = [f"{m} AS ({MODELS[m]})" for m in names] + list(ctes)
    return "WITH RECURSIVE " + ",\n".join(items) + "\n" + body if items else body
