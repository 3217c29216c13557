"""Named queries: calibration, streams, readers and models."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rnd
from ..operators import calibration as K
from ..operators import joins as J
from ..session import staging_path
from ..sources import adapters as A
from ..sources import readers as R
from ..streaming import streams as X
from ..udf import keep_topics, prepare_embedding_text, with_model
from .catalog_comments import ANNOTATED, STATUS
from .catalog_signals import CH, FIELDS
from .models_sql import r, sql


# ---- streams over the supplied files -----------------------------------------------------

def events_stream(s, d):
    return R.stream_table(s, d, "events", A.table(s, d, "events").schema)


def comments_stream(s, d):
    """Conversations as a stream of the comment model."""
    return A.comments_from(R.stream_table(s, d, "conversations", A.table(s, d, "conversations").schema))


def keyed(c):
    return c.withColumn("platform_comment_id", F.concat(F.lit("youtube:"), F.col("id") - F.col("id") % 2))


def appended(s, stream, name):
    """Rows that an append query over all available data writes; none is a table too."""
    return s.read.schema(stream.schema).parquet(X.drain(s, lambda out, ck: X.append_to(stream, out, ck), name))


def q_event_rate(s, d, **kw):
    return appended(s, X.event_rate(events_stream(s, d), **kw), "rate")


def q_comment_stream(s, d):
    return appended(s, X.comment_stream(keyed(comments_stream(s, d)), "400 days").select("platform_comment_id"), "intake")


def q_annotate_stream(s, d):
    return appended(s, X.annotate_stream(comments_stream(s, d), toxic_at=0.1).select("id", "status"), "annotate")


def q_author_state(s, d):
    out = X.drain(s, lambda o, ck: X.upsert_to(X.author_state(comments_stream(s, d)), o, ck), "authors")
    return X.latest_state(s, out, ["author_id"])


def q_edge_counter(s, d):
    e = events_stream(s, d).select(F.concat(F.lit("u"), "user_id").alias("source"), F.col("event_type").alias("target"), F.lit("DISCUSSES").alias("edge_type"))
    out = X.drain(s, lambda o, ck: X.upsert_to(X.edge_counter(e), o, ck), "edges")
    return X.latest_state(s, out, ["source", "target", "edge_type"])


def q_graph_event_log(s, d):
    return appended(s, X.graph_events(comments_stream(s, d)), "log")


def q_replay(s, d):
    return X.replay(q_graph_event_log(s, d), "2024-01-02", ["COMMENT_LINKED"], 100).select("timestamp", "event_type", "source_id", "target_id")


def q_interval_join(s, d):
    c = comments_stream(s, d).select("id", "timestamp_posted", (F.col("id") % 1000).alias("video_id"))
    u = events_stream(s, d).select((F.col("event_id") % 1000).alias("video_id"), F.col("ts").alias("uploaded_at"), "event_id")
    joined = X.interval_join(c, u.select("video_id", "uploaded_at"), 2, "60 days")
    return appended(s, joined.select("id", "video_id", "uploaded_at"), "ijoin")


def q_metric_stream(s, d):
    p = events_stream(s, d).select(F.col("ts").alias("timestamp"), F.col("event_type").alias("source"), "value")
    return appended(s, X.metric_stream(p, "1 hour"), "metrics")


def q_stream_recrawl(s, d):
    old, new = A.snapshots(s, d)
    path = staging_path(s, "snap")
    new.write.parquet(path)
    arriving = s.readStream.schema(new.schema).parquet(path)
    out = X.drain(s, lambda o, ck: X.stream_recrawl(arriving, old, o, ck), "recrawl")
    return s.read.parquet(out).select("platform_id", "status", F.array_join("fields_changed", ",").alias("fields"))


# ---- readers over files written from the tables ------------------------------------------

def staged_text(s, df, name):
    path = staging_path(s, name)
    df.write.text(path)
    return path


def q_read_channel_list(s, d):
    k = F.col("page_id")
    line = F.when(k % 7 == 0, F.concat(F.lit("# "), "url")).when(k % 11 == 0, "").when(k % 2 == 0, F.concat("url", F.lit(" | "), (k % 5 + 1).cast("string"))).otherwise(F.concat(F.lit("https://twitch.tv/"), k.cast("string")))
    return R.read_channel_list(s, staged_text(s, A.table(s, d, "pages").select(line.alias("value")), "channels")).withColumn("priority_tier", F.col("priority_tier").cast("long"))


def q_read_video_info(s, d):
    v, k = A.videos(s, d), F.col("id")
    rec = F.to_json(F.struct(k.cast("string").alias("id"), "title", F.col("url").alias("webpage_url"), F.col("duration_seconds").alias("duration"), "view_count", F.date_format("uploaded_at", "yyyyMMdd").alias("upload_date"),
                             "tags", F.when(k % 4 == 0, "was_live").alias("live_status"), F.when(k % 3 == 0, F.create_map(F.lit("en"), F.lit("x"), F.lit("de"), F.lit("y"))).alias("subtitles"),
                             F.when(k % 2 == 0, 60).alias("fps"), F.array(F.struct(F.lit("Intro").alias("title"), F.lit(0).alias("start_time"), (k % 30).alias("end_time"))).alias("chapters")))
    videos, chapters = R.read_video_info(s, staged_text(s, v.select(rec.alias("value")), "info"))
    j = videos.join(chapters.select("platform_id", "end_time"), "platform_id")
    return j.select("platform_id", "uploaded_at", "view_count", "live_status", F.array_join("caption_languages", ",").alias("languages"), F.coalesce(F.col("metadata")["fps"], F.lit("")).alias("fps"), F.col("end_time").cast("long").alias("intro_end"))


def q_read_comment_dump(s, d):
    c, k = A.comments(s, d), F.col("id")
    rec = F.to_json(F.struct(F.when(k % 3 != 0, k.cast("string")).alias("id"), F.col("author_id").alias("author"), "text", F.when(k % 2 == 0, F.col("like_count")).alias("like_count"),
                             F.col("parent_comment_id").cast("string").alias("parent"), F.unix_timestamp("timestamp_posted").cast("string").alias("timestamp")))
    df = R.read_comment_dump(s, staged_text(s, c.select(rec.alias("value")), "dump"), "youtube")
    return df.select("platform_comment_id", "author_id", "like_count", "parent_id", "timestamp_posted", F.length("text").alias("n"))


def q_read_subtitles(s, d):
    """Texts of documents as cues of a hundred videos in files <video>.<language>[.auto].<ext>; some have a manual file, some an automatic one, most both."""
    k = F.col("doc_id")
    cue = F.concat(F.lit("c"), F.regexp_replace(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n\r]+", "\n")), "\n", "\n\n"), F.lit("x\n"))
    name = lambda end: F.concat((k % 100).cast("string"), F.lit("."), F.coalesce("lang", F.lit("xx")), F.lit(end))
    t = A.table(s, d, "documents").withColumn("text", cue)
    rows = t.filter(k % 3 != 0).select(name(".vtt").alias("file"), "text").union(t.filter(k % 3 != 1).select(name(".auto.srt"), "text"))
    path = staging_path(s, "subtitles")
    R.write_named_texts(rows, path, "file", "text")
    got = R.read_subtitles(s, path, named_by_folder=True)
    return got.select(F.col("video_id").cast("long").alias("video_id"), "language", "format", "is_auto_generated", F.col("cue_count").cast("long").alias("cue_count"), F.length("content").cast("long").alias("chars"))


def q_read_calibration_samples(s, d):
    """Events by type and user as one JSON object a user."""
    e = A.table(s, d, "events").groupBy("user_id", "event_type").agg(F.collect_list(F.struct((F.col("value") / 100).alias("raw"), (F.col("event_id") % 2).cast("int").alias("truth"))).alias("samples"))
    objects = e.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "samples")))).alias("value"))
    got = R.read_calibration_samples(s, staged_text(s, objects.select("value"), "samples"), one_a_line=True)
    return got.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum("raw") * 1e4 + 0.5).alias("raw_sum"), F.sum("truth").alias("truths"))


def q_read_rules(s, d):
    """Weights by event type, written as a small file from the count of each type, read as parameters and applied to the events."""
    e = A.table(s, d, "events")
    line = F.concat(F.lit('  "'), "event_type", F.lit('": '), F.col("n").cast("string"))
    counts = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.array_sort(F.collect_list(line)), ",\n").alias("v"))
    path = staged_text(s, counts.select(F.concat(F.lit('{"weights": {\n'), "v", F.lit("\n}}")).alias("value")), "rules")
    weights = R.read_rules(path, s)["weights"]
    weight = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
    return e.groupBy("user_id").agg(F.sum(weight[F.col("event_type")].cast("long")).alias("weight"))


def q_save_load(s, d):
    path = staging_path(s, "tables")
    R.save_table(A.videos(s, d).select("id", "platform", "view_count"), f"{path}/videos", ["platform"])
    return R.load_tables(s, path, ["videos"])["videos"].select("id", F.col("platform").cast("string").alias("platform"), "view_count")


def q_upsert(s, d):
    v = A.videos(s, d).select("id", "title", "view_count")
    stored = v.filter("id % 3 <> 0").withColumn("updated_at", F.lit("2020-01-01").cast("timestamp"))
    fresh = v.filter("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, F.upper("title")).alias("title"), (F.col("view_count") + 1).alias("view_count"))
    fresh = fresh.withColumn("seen", F.lit(2)).unionByName(fresh.withColumns({"view_count": F.col("view_count") - 9, "seen": F.lit(1)}))
    return R.upsert(stored, fresh, ["id"], "2024-01-01", ["seen"])


def q_upsert_vectors(s, d):
    v = A.vectors(s, d).select("id", "collection")
    return R.upsert_vectors(v.filter("id % 3 = 0"), v.filter("id % 2 = 0").withColumn("collection", F.col("collection") + 100))


def q_delete_by_video(s, d):
    v = A.vectors(s, d).select("id", (F.col("id") % 20).alias("video_id"))
    return R.delete_by_video(v, A.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("video_id")).filter("video_id % 2 = 0"))


# ---- calibration -------------------------------------------------------------------------

def fixed_params(s):
    return s.createDataFrame([("audio.pitch_shift", "platt", True, 50, 2.0, -1.0, None, None, None), ("ocr.confidence", "isotonic", True, 50, None, None, None, [0.1, 0.4, 0.8], [0.2, 0.5, 0.95]),
                              ("clip.label_confidence", "temperature", True, 50, None, None, 0.5, None, None)], K.PARAMS)


def calibrated(s, d):
    return K.calibrate(A.calibration_samples(s, d), fixed_params(s))


def fit_loss(s, d, target, fit):
    x = A.calibration_samples(s, d).filter(F.col("target") == target)
    got = fit(x)
    return s.createDataFrame([(target, {k: float(v) for k, v in got.items() if isinstance(v, float)})], "target string, params map<string,double>").select(
        "target", F.explode("params").alias("name", "value")).select("target", "name", rnd("value", 3).alias("value"))


def fitted_values(s, d):
    """The isotonic fit applied to the scores it was fitted on."""
    x = A.calibration_samples(s, d).filter("target = 'ocr.confidence'")
    params = s.createDataFrame([("ocr.confidence", "isotonic", True, 50, None, None, None, *K.fit_isotonic(x).values())], K.PARAMS)
    return K.calibrate(x, params).select("raw", rnd("calibrated_probability", 4).alias("p")).distinct()


def scorer():
    """Toy model: length and vowel share of a text."""
    def score(texts):
        return {"n": [len(t) for t in texts], "label": ["long" if len(t) > 300 else "short" for t in texts]}
    return score


QUERIES = {
    "fit_platt": lambda s, d: fit_loss(s, d, "audio.pitch_shift", K.fit_platt),
    "fit_temperature": lambda s, d: fit_loss(s, d, "clip.label_confidence", K.fit_temperature),
    "fit_isotonic": fitted_values,
    "fit_all": lambda s, d: K.fit_all(A.calibration_samples(s, d)).select("target", "method", "fitted", "samples"),
    "calibration_status": lambda s, d: K.calibration_status(K.fit_all(A.calibration_samples(s, d))),
    "calibrate": lambda s, d: calibrated(s, d).groupBy("target", "raw", "band", "band_label").agg(F.count(F.lit(1)).alias("n"), rnd(F.max("calibrated_probability"), 6).alias("p")),
    "confidence_distribution": lambda s, d: K.confidence_distribution(calibrated(s, d)),
    "comment_stream": q_comment_stream,
    "annotate_stream": q_annotate_stream,
    "graph_event_log": q_graph_event_log,
    "replay": q_replay,
    "event_rate": q_event_rate,
    "event_rate_sliding": lambda s, d: q_event_rate(s, d, window="5 minutes", slide="1 minute"),
    "author_state": q_author_state,
    "edge_counter": q_edge_counter,
    "interval_join": q_interval_join,
    "metric_stream": q_metric_stream,
    "stream_recrawl": q_stream_recrawl,
    "read_channel_list": q_read_channel_list,
    "read_video_info": q_read_video_info,
    "read_comment_dump": q_read_comment_dump,
    "read_subtitles": q_read_subtitles,
    "read_calibration_samples": q_read_calibration_samples,
    "read_rules": q_read_rules,
    "save_and_load": q_save_load,
    "upsert": q_upsert,
    "upsert_vectors": q_upsert_vectors,
    "delete_by_video": q_delete_by_video,
    "with_model": lambda s, d: with_model(A.comments(s, d).select("id", "text"), scorer, "n long, label string").select("id", "n", "label"),
    "embedding_text": lambda s, d: A.table(s, d, "benchmark").select("item_id", prepare_embedding_text("text", "query").alias("t")),
    "keep_topics": lambda s, d: A.comments(s, d).select("id", F.array_join(keep_topics("topic_labels", F.transform("topic_labels", lambda x, i: (F.col("like_count") % 10 + i) / 10)), ",").alias("topics")),
    "new_only": lambda s, d: J.new_only(A.comments(s, d).select("id", "video_id"), A.comments(s, d).filter("id % 3 = 0"), "id"),
}

CAL = """ca AS (SELECT target, raw, least(1.0,greatest(0.0,CASE target WHEN 'audio.pitch_shift' THEN 1/(1+exp(-(2*raw-1))) WHEN 'clip.label_confidence' THEN 1/(1+exp(-raw/0.5))
   ELSE CASE WHEN raw<0.1 THEN 0.2 WHEN raw>=0.8 THEN 0.95 WHEN raw>=0.4 THEN 0.5+0.45*(raw-0.4)/0.4 ELSE 0.2+0.3*(raw-0.1)/0.3 END END)) AS p FROM calibration_samples),
  cb AS (SELECT *, CASE WHEN p>=0.9 THEN 'very_strong' WHEN p>=0.75 THEN 'strong' WHEN p>=0.5 THEN 'moderate' WHEN p>=0.25 THEN 'low' ELSE 'weak' END AS band,
   CASE WHEN p>=0.9 THEN 'Very Strong' WHEN p>=0.75 THEN 'Strong' WHEN p>=0.5 THEN 'Moderate' WHEN p>=0.25 THEN 'Low' ELSE 'Weak' END AS band_label FROM ca)"""
TARGETS = """tg AS (SELECT * FROM (VALUES ('audio.speed_anomaly','platt'),('audio.pitch_shift','platt'),('audio.compression','isotonic'),('audio.reverb_echo','platt'),('audio.robotic_autotune','platt'),('audio.time_stretch','platt'),
   ('audio.overall_manipulation','isotonic'),('audio.music_probability','temperature'),('audio.speech_probability','temperature'),('ocr.confidence','isotonic'),('whisper.segment_confidence','temperature'),
   ('clip.label_confidence','temperature'),('search.final_score','isotonic')) t(target,method)), tn AS (SELECT target, method, count(raw) AS samples FROM tg LEFT JOIN calibration_samples USING (target) GROUP BY 1,2)"""
CLOSED = "(SELECT max(ts) FROM events)-INTERVAL 10 MINUTE"
PLAIN = """lg AS (SELECT timestamp_posted AS timestamp, 'COMMENT_ADDED' AS event_type, 'Comment' AS node_type, CAST(id AS VARCHAR) AS node_id, CAST(NULL AS VARCHAR) AS edge_type, CAST(NULL AS VARCHAR) AS source_id, CAST(NULL AS VARCHAR) AS target_id FROM comments
   UNION ALL SELECT timestamp_posted, 'COMMENT_LINKED', NULL, NULL, 'REPLIES_TO', CAST(id AS VARCHAR), CAST(parent_comment_id AS VARCHAR) FROM comments WHERE parent_comment_id IS NOT NULL)"""

COND = "cd AS (SELECT least(n_chars/4000,1.0)::DOUBLE AS x, count(*)::DOUBLE AS n, sum({truth})::DOUBLE AS pos FROM labels JOIN documents USING (doc_id) GROUP BY 1)"
# logistic fit by Newton steps
NEWTON = "nw0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b), " + ", ".join(
    f"""ns{i} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum((pos-n*p)*x) AS ga, sum(pos-n*p) AS gb, sum(n*p*(1-p)*x*x) AS haa, sum(n*p*(1-p)*x) AS hab, sum(n*p*(1-p)) AS hbb FROM (SELECT *, 1/(1+exp(-(a*x+b))) AS p FROM cd, nw{i})),
  nw{i + 1} AS (SELECT a+(hbb*ga-hab*gb)/(haa*hbb-hab*hab) AS a, b+(haa*gb-hab*ga)/(haa*hbb-hab*hab) AS b FROM ns{i})""" for i in range(15))
# five grids of 41 temperatures, each around the best of the one before
GRIDS = "tb0 AS (SELECT 0.01::DOUBLE AS lo, 10.0::DOUBLE AS hi, 1.0::DOUBLE AS best), " + ", ".join(
    f"""tg{i} AS (SELECT lo, hi, lo+(hi-lo)*i/40 AS t FROM tb{i}, range(41) g(i)), tl{i} AS (SELECT t, any_value((hi-lo)/40) AS step, sum(-(pos*ln(p)+(n-pos)*ln(1-p))) AS loss FROM (
    SELECT *, greatest(1e-7, least(1-1e-7, 1/(1+exp(-x/t)))) AS p FROM cd, tg{i}) GROUP BY t), tb{i + 1} AS (SELECT greatest(0.01, t-step) AS lo, least(10.0, t+step) AS hi, t AS best FROM tl{i} ORDER BY loss, t LIMIT 1)""" for i in range(5))

ORACLE = {
    "fit_platt": f"WITH {COND.format(truth='quality')}, {NEWTON} SELECT 'audio.pitch_shift' AS target, 'a' AS name, {r('a', 3)} AS value FROM nw15 UNION ALL SELECT 'audio.pitch_shift', 'b', {r('b', 3)} FROM nw15",
    "fit_temperature": f"WITH {COND.format(truth='quality')}, {GRIDS} SELECT 'clip.label_confidence' AS target, 'temperature' AS name, {r('best', 3)} AS value FROM tb5",
    # the largest over starts at or before of the least mean up to ends at or after
    "fit_isotonic": f"""WITH {COND.format(truth='toxic')}, k AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(n) OVER (ORDER BY x) AS cn, sum(pos) OVER (ORDER BY x) AS cp FROM cd),
        m AS (SELECT s.i AS s, e.i AS e, (e.cp-s.cp+s.pos)/(e.cn-s.cn+s.n) AS mean FROM k s JOIN k e ON e.i>=s.i), u AS (SELECT s, e, min(mean) OVER (PARTITION BY s ORDER BY e DESC) AS low FROM m)
        SELECT k.x AS raw, {r('max(low)', 4)} AS p FROM k JOIN u ON u.s<=k.i AND u.e=k.i GROUP BY k.x""",
    "fit_all": sql("calibration_samples", "SELECT target, method, samples>=30 AS fitted, samples FROM tn", TARGETS),
    "calibration_status": sql("calibration_samples", "SELECT target, method, samples>=30 AS fitted, samples AS training_samples FROM tn", TARGETS),
    "calibrate": sql("calibration_samples", f"SELECT target, raw, band, band_label, count(*) AS n, {r('max(p)', 6)} AS p FROM cb GROUP BY 1,2,3,4", CAL),
    "confidence_distribution": sql("calibration_samples", f"SELECT target, band, count(*) AS n, {r('count(*)/sum(count(*)) OVER (PARTITION BY target)', 4)} AS share FROM cb GROUP BY 1,2", CAL),
    "comment_stream": sql("comments", "SELECT DISTINCT 'youtube:' || (id-id%2) AS platform_comment_id FROM comments"),
    "graph_event_log": sql("comments", "SELECT * FROM lg", PLAIN),
    "replay": sql("comments", "SELECT timestamp, event_type, source_id, target_id FROM lg WHERE event_type='COMMENT_LINKED' AND timestamp>='2024-01-02' ORDER BY timestamp DESC, source_id LIMIT 100", PLAIN),
    "event_rate": f"SELECT w AS window_start, w+INTERVAL 1 MINUTE AS window_end, event_type, n FROM (SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP) AS w, event_type, count(*) AS n FROM events GROUP BY 1,2) WHERE w+INTERVAL 1 MINUTE<={CLOSED}",
    "event_rate_sliding": f"""SELECT w AS window_start, w+INTERVAL 5 MINUTE AS window_end, event_type, n FROM (SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP)-k*INTERVAL 1 MINUTE AS w, event_type, count(*) AS n FROM events
        CROSS JOIN (SELECT unnest(range(5)) AS k) GROUP BY 1,2) WHERE w+INTERVAL 5 MINUTE<={CLOSED}""",
    "author_state": sql("comments", "SELECT author_id, count(*) AS comment_count, min(timestamp_posted) AS first_seen_at, max(timestamp_posted) AS last_seen_at FROM comments GROUP BY 1"),
    "edge_counter": "SELECT 'u' || user_id AS source, event_type AS target, 'DISCUSSES' AS edge_type, count(*) AS count FROM events GROUP BY 1,2",
    "interval_join": sql("comments", "SELECT c.id, c.id%1000 AS video_id, e.ts AS uploaded_at FROM comments c JOIN events e ON e.event_id%1000=c.id%1000 AND c.timestamp_posted>=e.ts AND c.timestamp_posted<=e.ts+INTERVAL 2 DAY"),
    "metric_stream": f"SELECT w AS bucket, event_type AS source, count, average FROM (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS w, event_type, count(*) AS count, {r('avg(value)', 4)} AS average FROM events GROUP BY 1,2) WHERE w+INTERVAL 1 HOUR<={CLOSED}",
    "read_channel_list": """SELECT url, priority_tier, 'other' AS platform FROM (SELECT url, CAST(page_id%5+1 AS BIGINT) AS priority_tier, page_id FROM pages WHERE page_id%7<>0 AND page_id%11<>0 AND page_id%2=0)
        UNION ALL SELECT 'https://twitch.tv/' || page_id, 1, 'twitch' FROM pages WHERE page_id%7<>0 AND page_id%11<>0 AND page_id%2=1""",
    "read_video_info": sql("videos", """SELECT 'youtube:' || id AS platform_id, uploaded_at, view_count, CASE WHEN id%4=0 THEN 'was_live' ELSE 'none' END AS live_status, CASE WHEN id%3=0 THEN 'de,en' ELSE '' END AS languages,
        CASE WHEN id%2=0 THEN '60' ELSE '' END AS fps, id%30 AS intro_end FROM videos"""),
    "read_subtitles": """WITH t AS (SELECT doc_id, doc_id%100 AS video_id, coalesce(lang,'xx') AS language,
          'c' || replace(trim(regexp_replace(coalesce(text,''), '[\\n\\r]+', chr(10), 'g'), ' '), chr(10), chr(10) || chr(10)) || 'x' AS cue FROM documents),
        f AS (SELECT video_id, language, cue, doc_id%3<>0 AS manual, doc_id%3<>1 AS automatic FROM t),
        g AS (SELECT video_id, language, false AS is_auto_generated, 'vtt' AS format, cue FROM f WHERE manual UNION ALL SELECT video_id, language, true, 'srt', cue FROM f WHERE automatic),
        h AS (SELECT video_id, language, is_auto_generated, format, CAST(sum(1+(length(cue)-length(replace(cue, chr(10) || chr(10), '')))//2) AS BIGINT) AS cue_count, CAST(sum(length(cue)+2) AS BIGINT) AS chars FROM g GROUP BY ALL)
        SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY video_id, language ORDER BY is_auto_generated)=1""",
    "read_calibration_samples": "SELECT event_type AS target, count(*) AS n, CAST(floor(sum(value/100)*1e4+0.5) AS BIGINT) AS raw_sum, CAST(sum(event_id%2) AS BIGINT) AS truths FROM events GROUP BY 1",
    "read_rules": "SELECT user_id, CAST(sum(n) AS BIGINT) AS weight FROM events JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type) GROUP BY 1",
    "read_comment_dump": sql("comments", """SELECT CASE WHEN id%3<>0 THEN 'youtube:' || id ELSE 'youtube:h' || substr(sha256('youtube:' || author_id || ':' || substr(text,1,100) || ':' || CAST(epoch(timestamp_posted) AS BIGINT)),1,16) END AS platform_comment_id,
        author_id, CASE WHEN id%2=0 THEN like_count ELSE 0 END AS like_count, coalesce(CAST(parent_comment_id AS VARCHAR),'root') AS parent_id, timestamp_posted, CAST(length(text) AS INT) AS n FROM comments"""),
    "save_and_load": sql("videos", "SELECT id, platform, view_count FROM videos"),
    "upsert": sql("videos", """SELECT id, coalesce(CASE WHEN id%4=0 THEN upper(title) END, CASE WHEN id%3<>0 THEN title END) AS title, CASE WHEN id%2=0 THEN view_count+1 ELSE view_count END AS view_count, CASE WHEN id%2=0 THEN 2 END AS seen,
        CASE WHEN id%2=0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2020-01-01' END AS updated_at FROM videos WHERE id%3<>0 OR id%2=0"""),
    "upsert_vectors": sql("vectors", "SELECT id, CASE WHEN id%2=0 THEN collection+100 ELSE collection END AS collection FROM vectors WHERE id%2=0 OR id%3=0"),
    "delete_by_video": sql("vectors", "SELECT id, id%20 AS video_id FROM vectors WHERE id%20 NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey%2=0)"),
    "with_model": sql("comments", "SELECT id, length(text) AS n, CASE WHEN length(text)>300 THEN 'long' ELSE 'short' END AS label FROM comments"),
    "embedding_text": "SELECT item_id, 'query: ' || text AS t FROM benchmark",
    "keep_topics": sql("comments", "SELECT id, array_to_string(list_filter(topic_labels, lambda x, i: (like_count%10+i-1)/10>=0.3)[1:5],',') AS topics FROM comments"),
    "new_only": sql("comments", "SELECT id, video_id FROM comments WHERE id%3<>0"),
    "annotate_stream": sql("comments", f"SELECT id, {STATUS} AS status FROM an", ANNOTATED),
    "stream_recrawl": sql("snap_old snap_new", f"""SELECT n.platform_id, CASE WHEN o.platform_id IS NULL THEN 'new' WHEN {' OR '.join(CH.format(f) for f in FIELDS)} THEN 'recrawled' ELSE 'no_changes' END AS status,
        array_to_string(list_filter([{', '.join(f"CASE WHEN {CH.format(f)} THEN '{f}' END" for f in FIELDS)}], lambda x: x IS NOT NULL),',') AS fields FROM snap_new n LEFT JOIN snap_old o USING (platform_id)"""),
}
