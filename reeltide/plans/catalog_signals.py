"""Named queries: signals and recrawls."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as G
from ..operators import filters as L
from ..operators import recrawl as R
from ..operators import signals as S
from ..sources import adapters as A
from .catalog_listing import RECRAWL, recrawl_events
from .catalog_time import text_durations
from .models_sql import r, sql, words

SPONSOR = {"sponsor": ["der", "tion"], "merch": ["ch"]}
FILL, HEDGE = ["and", "der"], ["the", "et"]


def pointers(s, d):
    e = A.audio_windows(s, d)
    return e.select("video_id", "id", F.col("start_time").alias("t"), F.col("music_probability").alias("x"), (F.col("harmonic_ratio") * 0.999).alias("y"), (F.col("dominant_source") == "music").alias("is_click"))


def edits(s, d):
    v = F.col("value")
    return A.table(s, d, "events").select(F.col("user_id").alias("video_id"), F.col("event_type").alias("action"), (F.col("event_id") % 9).alias("keystrokes"),
                                          F.when(F.col("event_id") % 4 != 0, v).alias("time_to_correction_ms"), (F.col("event_id") % 2 == 0).alias("is_syntax_fix"), (F.col("event_id") % 5 == 0).alias("is_logic_fix"))


def upload_vectors(s, d):
    v = A.table(s, d, "embeddings")
    return v.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 20).alias("channel_id"), F.timestamp_seconds(F.lit(1700000000) + F.col("vec_id") * 90000).alias("uploaded_at"), F.col("embedding").alias("vector"))


def crawl_series(s, d):
    """Three crawls of every part."""
    p = A.table(s, d, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_brand", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("i"))
    k, i = F.col("k"), F.col("i")
    return p.select(k.alias("video_id"), F.timestamp_seconds(F.lit(1700000000) + i * 100000 + k).alias("snapshot_ts"), F.timestamp_seconds(F.lit(1690000000) + k).alias("uploaded_at"),
                    F.when((k % 5 == 0) & (i == 2), F.upper("p_name")).when((k % 7 == 0) & (i == 1), None).otherwise(F.col("p_name")).alias("title"),
                    F.when((k % 3 == 0) & (i > 0), F.concat("p_brand", F.lit("!"))).otherwise(F.col("p_brand")).alias("description"),
                    F.when((k + i) % 4 != 0, F.when(k % 2 == 0, k * 10).otherwise(k * 10 + i)).alias("pinned_id"))


def thumbs(s, d):
    k = F.col("p_partkey")
    return A.table(s, d, "part").select(F.col("p_brand").alias("channel_id"), k.alias("video_id"), (F.col("p_size") / 50).alias("brightness"), (F.col("p_retailprice") % 100 / 100).alias("saturation"), (k % 10 / 10).alias("contrast"))


def described(s, d):
    """Page sources as descriptions with a few links."""
    k = F.col("page_id")
    return A.table(s, d, "pages").select(k.alias("video_id"), F.col("url").alias("own_url"), F.concat(
        "html", F.lit(" see "), "url", F.lit(" https://amzn.to/"), k.cast("string"), F.lit(" (https://www.shop.com/a?tag="), (k % 5).cast("string"), F.lit(")")).alias("text"))


def link_rows(s, d):
    return S.description_links(described(s, d))


def link_states(s, d):
    """Two checks of every link; some die at the second."""
    u = link_rows(s, d).select("url", F.length("url").alias("n")).distinct()
    return u.select("url", "n", F.explode(F.array(F.lit(1), F.lit(2))).alias("i")).select(
        "url", F.timestamp_seconds(F.lit(1700000000) + F.col("i") * 86400).alias("checked_at"), F.when((F.col("i") == 2) & (F.col("n") % 3 == 0), 404).when((F.col("n") % 7 == 0), 500).otherwise(200).alias("status"))


def video_starts(s, d):
    return A.comments(s, d).groupBy(F.col("video_id").alias("id")).agg((F.min("timestamp_posted") - F.expr("interval 2 hours")).alias("uploaded_at"))


def thinned(s, d):
    return A.comments(s, d).filter("id % 7 <> 1")


def prints(s, d):
    """Block hashes of lineitems: orders as videos, parts as content."""
    li = A.table(s, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("video_id"), F.col("l_suppkey").alias("channel_id"), F.col("l_linenumber").cast("double").alias("timestamp"),
                     F.concat(F.col("l_partkey") % 900, F.lit("x"), F.col("l_suppkey") % 10).alias("hash"))


def openings(s, d):
    o = A.table(s, d, "orders")
    return o.select(F.col("o_custkey").alias("channel_id"), F.col("o_orderkey").alias("video_id"), F.col("o_orderdate").alias("uploaded_at"), F.col("o_orderstatus").alias("first_hash"), F.col("o_orderpriority").alias("last_hash"))


def mixed(s, d):
    x = A.segments(s, d)
    return x.withColumn("language", F.when(F.col("id") % 4 == 0, "en").otherwise(F.col("language")))


def creators(s, d):
    return A.comments(s, d).select("channel_id", F.concat(F.lit("assistant_"), F.col("channel_id") % 7).alias("creator_id")).distinct()


def asked(s, d):
    m = A.mentions(s, d)
    return m.select("channel_id", "entity_id", "ts", F.when(F.col("source_id") % 5 == 0, "can you").otherwise("nice").alias("text"))


def answered(s, d):
    """Uploads of the channel that take up the entity: every mention line."""
    return A.mentions(s, d).select("channel_id", "entity_id", "ts")


def signal_tables(s, d):
    return {"upload_patterns": S.upload_patterns(A.uploads(s, d)), "link_health": link_rows(s, d), "sponsor_segments": S.sponsor_segments(A.segments(s, d), text_durations(s, d), SPONSOR),
            "recrawl_events": recrawl_events(s, d), "commenter_migrations": S.commenter_migration(A.comments(s, d))}


def all_counts(s, d):
    out = None
    for name, df in signal_tables(s, d).items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("signal"), "n")
        out = row if out is None else out.unionByName(row)
    return out


OLD_NEW = A.snapshots


def stored(s, d):
    """The old snapshot with a column that no crawl brings, a status and times."""
    k = F.col("platform_id")
    at = F.timestamp_seconds(F.lit(1600000000) + k)
    return OLD_NEW(s, d)[0].select("*", F.concat(F.lit("note "), k).alias("note"), F.when(k % 3 == 0, "queued").otherwise("indexed").alias("status"), at.alias("last_crawled_at"), at.alias("updated_at"))



QUERIES = {
    "recrawl_diff": lambda s, d: R.recrawl_diff(*OLD_NEW(s, d)).select("platform_id", "status", F.array_join("fields_changed", ",").alias("fields"), "title_changed", "description_changed",
                                                                     F.array_join(F.transform("delta", lambda x: F.concat(F.coalesce(x["old"], F.lit("?")), F.lit(">"), x["new"])), ",").alias("delta")),
    "apply_recrawl": lambda s, d: R.apply_recrawl(stored(s, d), OLD_NEW(s, d)[1], "2024-02-01"),
    "recrawl_comments": lambda s, d: R.recrawl_comments(A.comments(s, d).filter("id % 5 <> 2"), thinned(s, d)),
    "recrawl_history": lambda s, d: R.recrawl_history(recrawl_events(s, d)).select("id", "trigger", "video_id", "recrawled_at"),
    "cursor_heatmap_cells": lambda s, d: S.cursor_heatmap(pointers(s, d), 120.0)[0],
    "cursor_heatmap": lambda s, d: S.cursor_heatmap(pointers(s, d), 120.0)[1],
    "text_edit_summary": lambda s, d: S.text_edit_summary(edits(s, d)),
    "face_ratio": lambda s, d: S.face_ratio(A.frames(s, d), 120.0),
    "background_changes": lambda s, d: S.background_changes(upload_vectors(s, d)),
    "upload_patterns": lambda s, d: S.upload_patterns(A.dense_uploads(s, d)),
    "title_edits": lambda s, d: S.title_edits(crawl_series(s, d), ["title", "description"]),
    "palette_drift": lambda s, d: S.palette_drift(thumbs(s, d)),
    "description_links": lambda s, d: link_rows(s, d),
    "link_health": lambda s, d: S.link_health(S.link_checks(link_rows(s, d), link_states(s, d))),
    "link_health_by_domain": lambda s, d: S.link_health(S.link_checks(link_rows(s, d), link_states(s, d)), "domain"),
    "link_first_dead": lambda s, d: S.link_checks(link_rows(s, d), link_states(s, d)).select("video_id", "url", "alive", "first_dead"),
    "pinned_history": lambda s, d: S.pinned_history(crawl_series(s, d)),
    "sentiment_drift": lambda s, d: S.sentiment_drift(A.comments(s, d), video_starts(s, d)),
    "deleted_shadows": lambda s, d: S.deleted_shadows(thinned(s, d), A.comments(s, d)),
    "reuse": lambda s, d: S.reuse(prints(s, d), 1.0, 2.0),
    "sponsor_segments": lambda s, d: S.sponsor_segments(A.segments(s, d), text_durations(s, d), SPONSOR),
    "intro_outro": lambda s, d: S.intro_outro(openings(s, d)),
    "linguistic_profile": lambda s, d: S.linguistic_profile(mixed(s, d), 300, FILL, HEDGE),
    "language_shares": lambda s, d: S.language_shares(mixed(s, d)),
    "commenter_migration": lambda s, d: S.commenter_migration(A.comments(s, d)),
    "entity_propagation": lambda s, d: S.propagation_summary(A.mentions(s, d)),
    "parasocial": lambda s, d: S.parasocial(A.comments(s, d), creators(s, d)),
    "topic_gestation": lambda s, d: S.topic_gestation(asked(s, d), answered(s, d)),
    "room_clusters": lambda s, d: S.room_clusters(upload_vectors(s, d).withColumnRenamed("id", "video_id")),
    "signal_records": lambda s, d: L.signal_records(S.upload_patterns(A.uploads(s, d)), channel_id=7, order=[F.col("video_id")]),
    "graph_relational_signals": lambda s, d: L.graph_relational_signals(S.commenter_migration(A.comments(s, d)), S.propagation_summary(A.mentions(s, d)), S.parasocial(A.comments(s, d), creators(s, d)),
                                                                       S.topic_gestation(asked(s, d), answered(s, d)), channel_id=2)["commenter_migrations"],
    "video_signal_counts": lambda s, d: L.signal_counts(signal_tables(s, d)),
    "video_signals": lambda s, d: L.unified_signals(signal_tables(s, d)).groupBy("signal", "video_id").agg(F.count(F.lit(1)).alias("n")),
    "channel_signals": lambda s, d: L.channel_signals({**signal_tables(s, d), "entity_propagations": S.propagation_summary(A.mentions(s, d))}, A.videos(s, d), 2).groupBy("signal").agg(F.count(F.lit(1)).alias("n")),
    "signal_stats": lambda s, d: G.signal_stats(all_counts(s, d)),
}

CH = "(n.{0} IS NOT NULL AND n.{0} IS DISTINCT FROM o.{0})"
FIELDS = ["title", "description", "view_count", "like_count"]
PTR = """pt AS (SELECT video_id, id, start_time AS t, music_probability AS x, harmonic_ratio*0.999::DOUBLE AS y, dominant_source='music' AS cl, CAST(floor(start_time/120) AS BIGINT) AS win FROM audio_windows),
  pn AS (SELECT *, coalesce(lead(t) OVER w-t,0) AS dwell, coalesce(sqrt(pow(lead(x) OVER w-x,2)+pow(lead(y) OVER w-y,2)),0) AS step FROM pt WINDOW w AS (PARTITION BY video_id, win ORDER BY t, id))"""
SERIES = """cs AS (SELECT p_partkey AS k, p_partkey AS video_id, i, make_timestamp((1700000000+i*100000+p_partkey)*1000000) AS snapshot_ts, make_timestamp((1690000000+p_partkey)*1000000) AS uploaded_at,
    CASE WHEN p_partkey%5=0 AND i=2 THEN upper(p_name) WHEN p_partkey%7=0 AND i=1 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey%3=0 AND i>0 THEN p_brand || '!' ELSE p_brand END AS description,
    CASE WHEN (p_partkey+i)%4<>0 THEN CASE WHEN p_partkey%2=0 THEN p_partkey*10 ELSE p_partkey*10+i END END AS pinned_id FROM part CROSS JOIN (SELECT unnest(range(3)) AS i))"""
LINKS = r"""ds AS (SELECT page_id AS video_id, url AS own_url, html || ' see ' || url || ' https://amzn.to/' || page_id || ' (https://www.shop.com/a?tag=' || (page_id%5) || ')' AS text FROM pages),
  lx AS (SELECT video_id, own_url, unnest(list_distinct(regexp_extract_all(text, 'https?://[^\s)"''<>]+'))) AS url FROM ds),
  lk AS (SELECT video_id, url, regexp_replace(lower(regexp_extract(url,'^https?://([^/?#:]+)',1)),'^www\.','') AS domain, regexp_replace(lower(regexp_extract(url,'^https?://([^/?#:]+)',1)),'^www\.','') IN ('amzn.to','bit.ly')
    OR regexp_matches(url,'[?&](tag|ref)=') AS is_affiliate, contains(url,own_url) AS is_self FROM lx),
  st AS (SELECT url, CASE WHEN length(url)%7=0 THEN false ELSE true END AS ok1, NOT (length(url)%3=0 OR length(url)%7=0) AS ok2 FROM (SELECT DISTINCT url FROM lk)),
  lc AS (SELECT lk.*, ok2 AS alive, CASE WHEN ok2 THEN NULL WHEN ok1 THEN make_timestamp(1700172800000000) ELSE make_timestamp(1700086400000000) END AS first_dead FROM lk JOIN st USING (url))"""


def health(by):
    return f"WITH {LINKS} SELECT {by}, count(*) AS links, count(*) FILTER (WHERE NOT alive) AS dead, {r('count(*) FILTER (WHERE NOT alive)/count(*)', 4)} AS rot_rate, count(*) FILTER (WHERE is_affiliate) AS affiliate, count(*) FILTER (WHERE is_self) AS self_links FROM lc GROUP BY 1"


SPON = """tdur AS (SELECT video_id, max(end_time) AS duration_s FROM segments GROUP BY 1),
  s0 AS (SELECT video_id, id, start_time, end_time, CASE WHEN contains(lower(text),'der') OR contains(lower(text),'tion') THEN 'sponsor' WHEN contains(lower(text),'ch') THEN 'merch' END AS kind,
    row_number() OVER (PARTITION BY video_id ORDER BY start_time, id) AS pos FROM segments),
  s1 AS (SELECT *, CASE WHEN start_time-lag(end_time) OVER w<=5 THEN 0 ELSE 1 END AS st FROM s0 WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY video_id, kind ORDER BY start_time, id)),
  s2 AS (SELECT *, sum(st) OVER (PARTITION BY video_id, kind ORDER BY start_time, id) AS isl FROM s1),
  sp AS (SELECT video_id, kind AS sponsor_type, min(start_time) AS start_time, max(end_time) AS end_time, count(*) AS hits, max(pos)-min(pos)+1 AS span FROM s2 GROUP BY video_id, kind, isl)"""
MIG = f"""mg0 AS (SELECT author_id, channel_id, min(timestamp_posted) AS f, max(timestamp_posted) AS l FROM comments GROUP BY 1,2),
  mg1 AS (SELECT a.author_id, a.channel_id AS from_channel, b.channel_id AS to_channel, a.l AS la, b.f AS fb FROM mg0 a JOIN mg0 b ON a.author_id=b.author_id AND a.f<b.f AND a.l<b.l),
  mig AS (SELECT m.author_id, from_channel, to_channel, greatest(0, CAST(floor((epoch(any_value(la))-epoch(any_value(fb)))/86400) AS BIGINT)) AS overlap_days, {r('count(*) FILTER (WHERE c.channel_id=to_channel)/count(*)', 3)} AS confidence
    FROM mg1 m JOIN comments c ON c.author_id=m.author_id AND c.channel_id IN (from_channel,to_channel) AND c.timestamp_posted>=fb GROUP BY 1,2,3)"""
UPP = f"""up0 AS (SELECT *, hour(ts) AS h, lag(ts) OVER (PARTITION BY channel_id ORDER BY ts, video_id) AS p, avg(hour(ts)) OVER (PARTITION BY channel_id) AS m, stddev_pop(hour(ts)) OVER (PARTITION BY channel_id) AS sd FROM {{}}),
  upp AS (SELECT channel_id, video_id, h AS hour, isodow(ts)-1 AS weekday, CAST(floor((epoch_us(ts)-epoch_us(p))/1e6/86400) AS BIGINT) AS days_since_last, CASE WHEN sd>1e-9 THEN {r('(h-m)/sd', 4)} END AS hour_z,
    coalesce(CASE WHEN sd>1e-9 THEN abs((h-m)/sd)>2 END, false) AS is_anomalous FROM up0)"""
MIX = f"""mx AS (SELECT video_id, id, start_time, end_time, CASE WHEN id%4=0 THEN 'en' ELSE language END AS language, {words('text')} AS w FROM segments)"""
COUNTS = f"""all_counts AS (SELECT 'upload_patterns' AS signal, count(*) AS n FROM orders UNION ALL SELECT 'link_health', count(*) FROM lk UNION ALL SELECT 'sponsor_segments', count(*) FROM sp
  UNION ALL SELECT 'recrawl_events', count(*) FROM orders UNION ALL SELECT 'commenter_migrations', count(*) FROM mig)"""
VSIG = """SELECT 'upload_patterns' AS signal, o_orderkey AS video_id, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'link_health', video_id, count(*) FROM lk GROUP BY 2
  UNION ALL SELECT 'sponsor_segments', video_id, count(*) FROM sp GROUP BY 2 UNION ALL SELECT 'recrawl_events', o_custkey, count(*) FROM orders GROUP BY 2"""
CATEGORY = "CASE signal WHEN 'upload_patterns' THEN 'behavioral' WHEN 'link_health' THEN 'behavioral' WHEN 'sponsor_segments' THEN 'cross_video_forensics' WHEN 'recrawl_events' THEN 'recrawl' ELSE 'graph_relational' END"

ORACLE = {
    "recrawl_diff": sql("snap_old snap_new", f"""SELECT n.platform_id, CASE WHEN o.platform_id IS NULL THEN 'new' WHEN {' OR '.join(CH.format(f) for f in FIELDS)} THEN 'recrawled' ELSE 'no_changes' END AS status,
        array_to_string(list_filter([{', '.join(f"CASE WHEN {CH.format(f)} THEN '{f}' END" for f in FIELDS)}], lambda x: x IS NOT NULL),',') AS fields, {CH.format('title')} AS title_changed, {CH.format('description')} AS description_changed,
        array_to_string(list_filter([{', '.join(f"CASE WHEN {CH.format(f)} THEN coalesce(CAST(o.{f} AS VARCHAR),'?') || '>' || n.{f} END" for f in FIELDS)}], lambda x: x IS NOT NULL),',') AS delta
        FROM snap_new n LEFT JOIN snap_old o USING (platform_id)"""),
    "apply_recrawl": sql("snap_old snap_new", f"""SELECT platform_id, {', '.join(f'coalesce(n.{f}, o.{f}) AS {f}' for f in FIELDS)}, CASE WHEN n.platform_id IS NOT NULL AND ({' OR '.join(CH.format(f) for f in FIELDS)}) THEN 'reindexing' WHEN platform_id%3=0 THEN 'queued' ELSE 'indexed' END AS status, 'note ' || platform_id AS note,
        CASE WHEN n.platform_id IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE make_timestamp((1600000000+platform_id)*1000000) END AS last_crawled_at,
        CASE WHEN n.platform_id IS NOT NULL AND ({' OR '.join(CH.format(f) for f in FIELDS)}) THEN TIMESTAMP '2024-02-01' ELSE make_timestamp((1600000000+platform_id)*1000000) END AS updated_at
        FROM snap_old o LEFT JOIN snap_new n USING (platform_id)"""),
    "recrawl_comments": sql("comments", """SELECT video_id, count(*) FILTER (WHERE id%5=2 AND id%7<>1) AS comments_added, count(*) FILTER (WHERE id%5<>2 AND id%7=1) AS comments_deleted FROM comments GROUP BY 1
        HAVING count(*) FILTER (WHERE (id%5=2)<>(id%7=1))>0"""),
    "recrawl_history": f"WITH {RECRAWL} SELECT id, trigger, video_id, recrawled_at FROM rc ORDER BY recrawled_at DESC, id LIMIT 50",
    "cursor_heatmap_cells": sql("audio_windows", f"SELECT video_id, win, CAST(floor(x*16) AS BIGINT) AS cx, CAST(floor(y*10) AS BIGINT) AS cy, {r('sum(dwell)', 3)} AS dwell_s, count(*) FILTER (WHERE cl) AS clicks FROM pn GROUP BY 1,2,3,4", PTR),
    "cursor_heatmap": sql("audio_windows", f"""SELECT video_id, win, CASE WHEN sum(dwell)>0 THEN {r('sum(x*dwell)/sum(dwell)', 4)} END AS hotspot_x, CASE WHEN sum(dwell)>0 THEN {r('sum(y*dwell)/sum(dwell)', 4)} END AS hotspot_y,
        {r('sum(step)', 4)} AS distance, {r('sum(step)/120', 4)} AS velocity, CASE WHEN sum(dwell)>0 THEN {r('sum(CASE WHEN step<2/1000 THEN dwell ELSE 0 END)/sum(dwell)', 4)} END AS idle_ratio FROM pn GROUP BY 1,2""", PTR),
    "text_edit_summary": f"""SELECT user_id AS video_id, event_type AS action, count(*) AS edits, CAST(sum(event_id%9) AS BIGINT) AS keystrokes, {r('avg(CASE WHEN event_id%4<>0 THEN value END)', 2)} AS mean_correction_ms,
        count(*) FILTER (WHERE event_id%2=0) AS syntax_fixes, count(*) FILTER (WHERE event_id%5=0) AS logic_fixes FROM events GROUP BY 1,2""",
    "face_ratio": sql("frames", f"SELECT video_id, CAST(floor(timestamp/120) AS BIGINT) AS win, {r('count(*) FILTER (WHERE face_count>0)/count(*)', 4)} AS face_ratio, max(face_count) AS max_faces, {r('avg(face_area)', 4)} AS mean_area FROM frames GROUP BY 1,2"),
    "background_changes": f"""SELECT channel_id, from_video, to_video, c AS similarity, {r('1-c', 4)} AS distance FROM (SELECT channel_id, lag(vec_id) OVER w AS from_video, vec_id AS to_video,
        {r('list_dot_product(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER w)/(sqrt(list_dot_product(embedding::DOUBLE[],embedding::DOUBLE[]))*sqrt(list_dot_product(lag(embedding::DOUBLE[]) OVER w,lag(embedding::DOUBLE[]) OVER w)))', 4)} AS c
        FROM (SELECT *, vec_id%20 AS channel_id FROM embeddings) WINDOW w AS (PARTITION BY channel_id ORDER BY vec_id)) WHERE c<0.6""",
    "upload_patterns": sql("dense_uploads", "SELECT * FROM upp", UPP.format("dense_uploads")),
    "title_edits": f"""WITH {SERIES}, sl AS (SELECT *, lag(title) OVER w AS pt, lag(description) OVER w AS pd, lag(i) OVER w AS pi FROM cs WINDOW w AS (PARTITION BY video_id ORDER BY snapshot_ts))
        SELECT video_id, snapshot_ts, {r('(epoch(snapshot_ts)-epoch(uploaded_at))/3600.0', 1)} AS hours_after_upload, field, old_value, new_value FROM (
          SELECT *, 'title' AS field, pt AS old_value, title AS new_value FROM sl UNION ALL SELECT *, 'description', pd, description FROM sl) WHERE pi IS NOT NULL AND old_value IS DISTINCT FROM new_value""",
    "palette_drift": f"""SELECT channel_id, video_id, {r('sqrt(pow(b-avg(b) OVER w,2)+pow(s-avg(s) OVER w,2)+pow(c-avg(c) OVER w,2))', 4)} AS drift FROM (SELECT p_brand AS channel_id, p_partkey AS video_id, p_size/50 AS b, p_retailprice%100/100 AS s, p_partkey%10/10 AS c FROM part)
        WINDOW w AS (PARTITION BY channel_id)""",
    "description_links": f"WITH {LINKS} SELECT * FROM lk",
    "link_health": health("video_id"),
    "link_health_by_domain": health("domain"),
    "link_first_dead": f"WITH {LINKS} SELECT video_id, url, alive, first_dead FROM lc",
    "pinned_history": f"""WITH {SERIES}, p1 AS (SELECT *, lag(pinned_id) OVER w AS pp, lead(snapshot_ts) OVER w AS nx, row_number() OVER w AS rn FROM cs WINDOW w AS (PARTITION BY video_id ORDER BY snapshot_ts)),
        p2 AS (SELECT *, sum(CASE WHEN rn=1 OR pp IS DISTINCT FROM pinned_id THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY snapshot_ts) AS isl FROM p1)
        SELECT video_id, any_value(pinned_id) AS pinned_id, min(snapshot_ts) AS detected_at, arg_max(CASE WHEN nx IS NULL THEN NULL ELSE nx END, i) AS unpinned_at FROM p2 WHERE pinned_id IS NOT NULL GROUP BY video_id, isl""".replace(
            "arg_max(CASE WHEN nx IS NULL THEN NULL ELSE nx END, i)", "CASE WHEN count(nx)=count(*) THEN max(nx) END"),
    "sentiment_drift": sql("comments", f"""SELECT c.video_id, w AS time_window, count(*) AS comment_count, {r('avg(sentiment_score)', 4)} AS avg_sentiment, {r('count(*) FILTER (WHERE sentiment_score>0.2)/count(*)', 4)} AS positive_ratio,
        {r('count(*) FILTER (WHERE sentiment_score<-0.2)/count(*)', 4)} AS negative_ratio, {r('coalesce(avg(toxicity_score),0)', 4)} AS toxicity FROM comments c JOIN (SELECT video_id, min(timestamp_posted)-INTERVAL 2 HOUR AS u FROM comments GROUP BY 1) v USING (video_id)
        JOIN (VALUES ('hour_1',1),('day_1',24),('day_7',168),('day_30',720),('day_90',2160)) t(w,h) ON epoch(timestamp_posted)-epoch(u) BETWEEN 0 AND h*3600 GROUP BY 1,2"""),
    "deleted_shadows": sql("comments", """SELECT p.id, n AS orphaned_replies, p.text AS last_text, p.author_id AS last_author FROM comments p JOIN (SELECT parent_comment_id AS id, count(*) AS n FROM comments WHERE id%7<>1 AND parent_comment_id IS NOT NULL GROUP BY 1) USING (id)
        WHERE p.id%7=1"""),
    "reuse": """WITH p AS (SELECT DISTINCT l_orderkey AS v, l_linenumber AS k, (l_partkey%900) || 'x' || (l_suppkey%10) AS h, l_suppkey AS c FROM lineitem), w AS (SELECT h, count(DISTINCT c)>=3 AS stock FROM p GROUP BY 1 HAVING count(DISTINCT v)>1),
        m AS (SELECT x.v AS a, y.v AS b, x.k AS ka, y.k-x.k AS o, bool_or(stock) AS stock, min(ka0) AS z FROM (SELECT p.*, stock, 0 AS ka0 FROM p JOIN w USING (h)) x JOIN p y ON x.h=y.h AND x.v<y.v GROUP BY 1,2,3,4),
        i AS (SELECT *, ka-row_number() OVER (PARTITION BY a,b,o ORDER BY ka) AS isl FROM m) SELECT a, b, min(ka)::DOUBLE AS start_a, (min(ka)+o)::DOUBLE AS start_b, count(*)::DOUBLE AS duration, bool_or(stock) AS is_stock FROM i GROUP BY a,b,o,isl HAVING count(*)>=2""",
    "sponsor_segments": sql("segments", f"SELECT video_id, sponsor_type, start_time, end_time, {r('end_time-start_time', 3)} AS duration, {r('start_time/greatest(duration_s,1e-9)', 4)} AS position_ratio, {r('hits/span', 4)} AS confidence FROM sp JOIN tdur USING (video_id)", SPON),
    "intro_outro": """WITH x AS (SELECT o_custkey AS channel_id, o_orderkey AS video_id, o_orderdate AS t, count(*) OVER (PARTITION BY o_custkey, o_orderstatus)>=2 AS has_intro, count(*) OVER (PARTITION BY o_custkey, o_orderpriority)>=2 AS has_outro FROM orders)
        SELECT channel_id, video_id, has_intro, has_outro, coalesce(lag(has_intro) OVER w AND NOT has_intro, false) AS intro_dropped, coalesce(lag(has_outro) OVER w AND NOT has_outro, false) AS outro_dropped FROM x WINDOW w AS (PARTITION BY channel_id ORDER BY t, video_id)""",
    "linguistic_profile": sql("segments", f"""SELECT video_id, code_switches, languages, filler_count, hedge_count, coalesce(u,0) AS unique_words, {r('coalesce(u,0)/greatest(words,1)', 4)} AS type_token_ratio, coalesce(rare,0) AS rare_words, {r('slope+1', 3)} AS zipf_deviation,
        {r('words/greatest(ln/60,1.0)', 2)} AS wpm FROM (SELECT video_id, count(*) FILTER (WHERE pl<>language) AS code_switches, count(DISTINCT language) AS languages, CAST(sum(len(list_filter(w, lambda x: x IN ('and','der')))) AS BIGINT) AS filler_count,
          CAST(sum(len(list_filter(w, lambda x: x IN ('the','et')))) AS BIGINT) AS hedge_count, sum(len(w)) AS words, max(end_time) AS ln FROM (SELECT *, lag(language) OVER (PARTITION BY video_id ORDER BY start_time, id) AS pl FROM mx) GROUP BY 1)
        LEFT JOIN (SELECT video_id, count(*) AS u, count(*) FILTER (WHERE word NOT IN (SELECT word FROM tp)) AS rare, regr_slope(ln(c), ln(rk)) AS slope FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY c DESC, word) AS rk FROM wc) GROUP BY 1) USING (video_id)""",
        MIX, "wx AS (SELECT video_id, unnest(w) AS word FROM mx)", "wc AS (SELECT video_id, word, count(*) AS c FROM wx GROUP BY 1,2)", "tp AS (SELECT word FROM wx GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 300)"),
    "language_shares": sql("segments", f"SELECT video_id, language, {r('count(*)/sum(count(*)) OVER (PARTITION BY video_id)', 4)} AS share FROM mx GROUP BY 1,2", MIX),
    "commenter_migration": sql("comments", "SELECT * FROM mig", MIG),
    "entity_propagation": sql("mentions", f"""SELECT entity_id, origin_channel, count(*) AS adopters, {r('avg(lag)', 1)} AS avg_lag_hours FROM (SELECT entity_id, channel_id, first_value(channel_id) OVER w AS origin_channel, (epoch(f)-epoch(first_value(f) OVER w))/3600.0 AS lag
        FROM (SELECT entity_id, channel_id, min(ts) AS f FROM mentions GROUP BY 1,2) WINDOW w AS (PARTITION BY entity_id ORDER BY f, channel_id)) WHERE channel_id<>origin_channel GROUP BY 1,2"""),
    "parasocial": sql("comments", f"""SELECT author_id, channel_id, n AS comments, coalesce(k,0) AS creator_replies, {r('coalesce(k,0)/n', 4)} AS reply_ratio, CASE WHEN n>30 THEN 'superfan' WHEN n>10 THEN 'regular' ELSE 'casual' END AS tier FROM (
        SELECT author_id, channel_id, count(*) AS n FROM comments GROUP BY 1,2) LEFT JOIN (SELECT p.author_id, p.channel_id, count(*) AS k FROM comments c JOIN comments p ON c.parent_comment_id=p.id
          WHERE c.author_id='assistant_' || (p.channel_id%7) GROUP BY 1,2) USING (author_id, channel_id) WHERE author_id<>'assistant_' || (channel_id%7)"""),
    "topic_gestation": sql("mentions", """SELECT channel_id, entity_id, any_value(f) AS first_comment_at, any_value(v) AS first_video_at, any_value(CAST(floor((epoch(v)-epoch(f))/86400) AS BIGINT)) AS gestation_days, count(*) AS mentions_before, bool_or(source_id%5=0) AS audience_requested
        FROM mentions m JOIN (SELECT channel_id, entity_id, f, min(ts) AS v FROM mentions JOIN (SELECT channel_id, entity_id, min(ts) AS f FROM mentions GROUP BY 1,2) USING (channel_id, entity_id) WHERE ts>f GROUP BY 1,2,3) USING (channel_id, entity_id)
        WHERE m.ts<v GROUP BY 1,2"""),
    "signal_records": sql("uploads", "SELECT * FROM upp WHERE channel_id=7 ORDER BY video_id LIMIT 50", UPP.format("uploads")),
    "graph_relational_signals": sql("comments", "SELECT * FROM mig WHERE from_channel=2 OR to_channel=2", MIG),
    "video_signal_counts": sql("segments", VSIG, LINKS, SPON),
    "video_signals": sql("segments", VSIG, LINKS, SPON),
    "channel_signals": sql("segments videos comments", """SELECT 'upload_patterns' AS signal, count(*) AS n FROM orders WHERE o_custkey=2 HAVING count(*)>0 UNION ALL SELECT 'sponsor_segments', count(*) FROM sp WHERE video_id IN (SELECT id FROM videos WHERE channel_id=2) HAVING count(*)>0
        UNION ALL SELECT 'link_health', count(*) FROM lk WHERE video_id IN (SELECT id FROM videos WHERE channel_id=2) HAVING count(*)>0 UNION ALL SELECT 'recrawl_events', count(*) FROM orders WHERE o_custkey IN (SELECT id FROM videos WHERE channel_id=2) HAVING count(*)>0
        UNION ALL SELECT 'commenter_migrations', count(*) FROM mig WHERE from_channel=2 OR to_channel=2 HAVING count(*)>0""", LINKS, SPON, MIG),
    "signal_stats": sql("segments comments", f"""SELECT coalesce(category,'all') AS category, coalesce(signal,'all') AS signal, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, {CATEGORY} AS category FROM all_counts) GROUP BY ROLLUP(category, signal)""", LINKS, SPON, MIG, COUNTS),
}
