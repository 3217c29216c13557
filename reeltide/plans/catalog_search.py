"""Named queries: vectors and search."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicons import ACTION_WORDS, CONTEXT_PATTERNS, EMOTION_WORDS, ERA_PATTERNS, FUSION_WEIGHTS, QUERY_STOPWORDS
from ..operators import search as S
from ..operators import vectors as V
from ..sources import adapters as A
from .models_sql import in_list, r, sql

NAMES = ["music", "the", "and", "loud", "fast"]


def documents_with_vectors(s, d):
    """All documents; the vectors are handed round, as there are fewer of them."""
    v = A.vectors(s, d)
    t = A.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % v.count()).alias("_v"))
    return t.join(v.withColumnRenamed("id", "_v"), "_v").drop("_v")


def corpus(s, d):
    """Documents as evidence: a quarter frames, a quarter comments, the rest transcript, ten to a video."""
    i = F.col("id")
    return documents_with_vectors(s, d).select(
        "id", "vector", (i % 4).alias("kind"), F.floor(i / 10).cast("long").alias("video_id"), (i % 10 * 7.0).alias("timestamp"), (i % 10 * 7.0 + 15.0).alias("end_time"),
        "text", i.cast("string").alias("ocr_text"), (i % 10 / 10).alias("confidence"), ((i * 31 % 21 - 10) / 10).alias("sentiment_score"),
        F.concat(F.lit("a"), i % 7).alias("author_id"), F.array((i % 70).cast("double")).alias("ts_seconds"), F.array(F.concat(F.lit("tag"), i % 5)).alias("visual_tags"), "collection")


def questions(s, d):
    """Every benchmark item as a query, with a vector of its own."""
    v = A.vectors(s, d)
    b = A.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", (F.col("item_id") * 7 % v.count()).alias("id"))
    return b.join(v.select("id", "vector"), "id").select("query_id", "vector", F.concat(F.lit("loud music fast playing "), F.col("query_id"), F.lit(" "), "text").alias("text"))


def natural(s, d):
    """Benchmark texts with words of the query lexicons."""
    extra = F.element_at(F.array(*[F.lit(x) for x in EXTRA]), (F.col("item_id") % len(EXTRA) + 1).cast("int"))
    return A.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" "), extra, F.lit(" "), F.col("item_id")).alias("text"))


EXTRA = ["guy struggling playing tetris at score 1,296", "retro night podcast", "happy sad cooking how-to 12:30", "latest gameplay review", "calm singing concert 3.5", "daily routine"]


def audio(s, d):
    return A.audio_windows(s, d).withColumn("event_labels", F.transform("event_tags", lambda t: t["label"]))


def dictionary(s, d):
    c = corpus(s, d)
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.col("collection") % 5 + 1).cast("int"))
    return c.select("video_id", name.alias("entity")).distinct()


def tables(s, d):
    c, names = corpus(s, d), dictionary(s, d)
    return {"segments": c.filter("kind < 2"), "frames": c.filter("kind = 2"), "comments": c.filter("kind = 3"), "audio": audio(s, d),
            "alignments": A.segments(s, d).withColumnRenamed("confidence", "alignment_score"), "entities": names.select(F.col("entity").alias("canonical_name")), "video_entities": names,
            "change_points": A.audio_windows(s, d).select("video_id", F.col("start_time").alias("timestamp"), F.col("music_probability").alias("magnitude")),
            "videos": A.videos(s, d), "channels": A.channels(s, d)}


def scores(e):
    return e.select("query_id", "video_id", "bucket", *[F.floor(F.col(m) * 1e5 + 0.500001).alias(m) for m in [*S.MODALITIES, "final_score"]])


def search(s, d, filters=None):
    return S.search(questions(s, d), tables(s, d), filters).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "video_id", "video_title", "channel_name", "timestamp", F.floor(F.col("confidence_score") * 1e4 + 0.5).alias("score"), "video_url_with_timecode", "view_count",
        "transcript_snippet", F.array_join("visual_tags", "|").alias("tags"), "ocr_text", "explanation")


FILTERS = {"language": "en", "min_views": 50000, "min_confidence": 0.3}


def votes(s, d):
    return A.feedback(s, d)


def ranked_results(s, d):
    f = A.feedback(s, d)
    return f.groupBy("query_text", "video_id").agg(F.count(F.lit(1)).cast("double").alias("score"))


QUERIES = {
    "vector_topk": lambda s, d: V.vector_topk(A.vectors(s, d), A.query_vectors(s, d), 20).withColumn("score", F.floor(F.col("score") * 1e4 + 0.5)),
    "vector_topk_filtered": lambda s, d: V.vector_topk(A.vectors(s, d).filter("collection < 5"), A.query_vectors(s, d), 10).select("query_id", "id", "rank"),
    "collection_stats": lambda s, d: V.collection_stats(A.vectors(s, d)),
    "near_duplicates": lambda s, d: V.near_duplicates(doubled(s, d), 0.98),
    "vector_topk_blocks": lambda s, d: V.vector_topk(A.vectors(s, d), A.vectors(s, d).withColumnRenamed("id", "query_id"), 5, block=64, slice_rows=300).select("query_id", "id", "rank"),
    "zero_shot_labels": lambda s, d: V.zero_shot_labels(A.vectors(s, d), label_vectors(s, d), top_k=3, scale=5.0).select("id", "category", "label", F.col("rank").cast("long").alias("rank")),
    "decompose_query": lambda s, d: S.decompose_query(natural(s, d)).select(
        "query_id", "emotion", "time_era", "context", *[F.array_join(c, "|").alias(c) for c in ("numbers", "actions", "objects", "keywords")]),
    "sub_queries": lambda s, d: S.sub_queries(S.decompose_query(natural(s, d))).select("query_id", "keyword", "ocr", "visual", "emotion"),
    "fused_scores": lambda s, d: scores(S.score_hits(questions(s, d), tables(s, d))),
    "search": search,
    "search_filtered": lambda s, d: search(s, d, FILTERS),
    "recalibrate_weights": lambda s, d: S.recalibrate_weights(votes(s, d), "2024-01-31"),
    "precision_at_k": lambda s, d: S.precision_at_k(ranked_results(s, d), votes(s, d)),
}


def doubled(s, d):
    """Vectors with an exact copy and a slightly bent copy of every one."""
    v = A.vectors(s, d)
    bent = F.transform("vector", lambda x, i: F.when(i == 0, x + F.lit(0.05).cast("float")).otherwise(x))
    return v.select("id", "vector").unionByName(v.select((F.col("id") + 1000000).alias("id"), "vector")).unionByName(v.select((F.col("id") + 2000000).alias("id"), bent.alias("vector")))


def label_vectors(s, d):
    """The first vectors of each collection as label prototypes: their mean per collection and parity."""
    v = A.vectors(s, d)
    mean = v.select("id", "collection", F.posexplode("vector").alias("i", "x")).groupBy((F.col("id") % 2).alias("p"), "collection", "i").agg(F.avg("x").alias("x"))
    g = mean.groupBy("p", "collection").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("label_vector"))
    return g.select(F.when(F.col("p") == 0, "scene").otherwise("object").alias("category"), F.concat(F.lit("l"), "collection").alias("label"), "label_vector")


COS = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])/(sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]))*sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"


def cos(a, b):
    return COS.format(a=a, b=b)


def score6(a, b):
    return f"floor({cos(a, b)}*1e6+0.500001)/1e6"


TOPK = f"""tk AS (SELECT q.id AS query_id, c.id, {score6('c.vector', 'q.vector')} AS score, c.collection FROM vectors c CROSS JOIN vectors q WHERE q.id%50=0)"""
NATURAL = "nat AS (SELECT item_id AS query_id, text || ' ' || [" + ",".join(f"'{x}'" for x in EXTRA) + f"][item_id%{len(EXTRA)}+1] || ' ' || item_id AS text FROM benchmark)"


def decompose(source):
    era = " ".join(f"WHEN regexp_matches(lo,'{p}') THEN '{n}'" for p, n in ERA_PATTERNS)
    ctx = " ".join(f"WHEN regexp_matches(lo,'{p}') THEN '{n}'" for p, n in CONTEXT_PATTERNS)
    return rf"""dw AS (SELECT query_id, text, lower(trim(text)) AS lo, list_distinct(regexp_extract_all(lower(trim(text)), '[\p{{L}}\p{{N}}_]+')) AS w FROM {source}),
  dd AS (SELECT *, regexp_extract_all(lo,'\b\d[\d,.:]*\d|\b\d+\b') AS numbers, list_min(list_filter(w, lambda x: x IN {in_list(EMOTION_WORDS)})) AS emotion,
    list_sort(list_filter(w, lambda x: x IN {in_list(ACTION_WORDS)})) AS actions, CASE {era} END AS time_era, CASE {ctx} END AS context,
    list_sort(list_filter(w, lambda x: x NOT IN {in_list(ACTION_WORDS + EMOTION_WORDS + QUERY_STOPWORDS)} AND NOT list_contains(regexp_extract_all(lo,'\b\d+\b'), x))) AS objects FROM dw),
  de AS (SELECT *, list_sort(list_distinct(list_concat(list_concat(objects, actions), numbers))) AS keywords FROM dd)"""


W = FUSION_WEIGHTS
ENTRIES = ", ".join([f"""cp0 AS (SELECT d.doc_id AS id, vector, d.doc_id%4 AS kind, d.doc_id//10 AS video_id, d.doc_id%10*7.0::DOUBLE AS timestamp, d.doc_id%10*7.0::DOUBLE+15 AS end_time, text, CAST(d.doc_id AS VARCHAR) AS ocr,
    (d.doc_id%10)/10 AS confidence, (d.doc_id*31%21-10)/10 AS sentiment, 'a' || (d.doc_id%7) AS author_id, (d.doc_id%70)::DOUBLE AS tss, collection FROM documents d JOIN vectors v ON v.id=d.doc_id%(SELECT count(*) FROM vectors)), cp AS (SELECT * FROM cp0 WHERE true)""",
    "qs AS (SELECT b.item_id AS query_id, vector, 'loud music fast playing ' || b.item_id || ' ' || b.text AS text FROM benchmark b JOIN vectors v ON v.id=b.item_id*7%(SELECT count(*) FROM vectors))",
    decompose("qs"),
    f"""ht AS (SELECT query_id, cp.*, CASE WHEN kind<2 THEN 0 ELSE kind END AS part, {score6('cp.vector', 'qs.vector')} AS score FROM cp CROSS JOIN qs),
  hk AS (SELECT * FROM ht QUALIFY row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, id)<=200),
  hb AS (SELECT *, CAST(floor(timestamp/10)*10 AS BIGINT) AS bucket FROM hk),
  ht2 AS (SELECT * FROM hb WHERE part=0 QUALIFY row_number() OVER (PARTITION BY query_id, video_id, bucket ORDER BY score DESC, timestamp)=1),
  hv2 AS (SELECT * FROM hb WHERE part=2 QUALIFY row_number() OVER (PARTITION BY query_id, video_id, bucket ORDER BY score DESC, timestamp)=1),
  en AS (SELECT query_id, video_id, bucket, coalesce(t.timestamp, v.timestamp) AS timestamp, coalesce(t.score,0) AS text_semantic, coalesce(v.score,0) AS visual_similarity,
    t.text, t.ocr, CASE WHEN v.id IS NOT NULL THEN 'tag' || (v.id%5) END AS vtag, coalesce(t.confidence,0.5) AS confidence FROM ht2 t FULL JOIN hv2 v USING (query_id, video_id, bucket)),
  e2 AS (SELECT en.*, CASE WHEN en.text IS NOT NULL AND len(numbers)>0 THEN len(list_filter(numbers, lambda n: contains(en.ocr,n)))/len(numbers) ELSE 0 END AS ocr_match,
    CASE WHEN en.text IS NOT NULL AND len(keywords)>0 THEN len(list_filter(keywords, lambda n: contains(lower(en.text),n)))/len(keywords) ELSE 0 END AS keyword_match, objects, actions, lower(de.text) AS ql
    FROM en JOIN de USING (query_id)),
  cm AS (SELECT query_id, video_id, max(score) AS cs, (max({{'s': score, 'o': -id, 't': tss}})).t AS bt, count(*) AS cn, var_samp(sentiment) AS cv, count(DISTINCT author_id) AS ca FROM hb WHERE part=3 GROUP BY 1,2),
  ve AS (SELECT DISTINCT video_id, ['music','the','and','loud','fast'][collection%5+1] AS entity FROM cp0),
  qe AS (SELECT DISTINCT query_id, entity FROM qs JOIN (SELECT DISTINCT entity FROM ve) ON contains(lower(text), entity)),
  eo AS (SELECT query_id, video_id, count(*)/any_value(n) AS entity_overlap FROM qe JOIN ve USING (entity) JOIN (SELECT query_id, count(*) AS n FROM qe GROUP BY 1) USING (query_id) GROUP BY 1,2),
  an AS (SELECT query_id, e2.video_id, bucket, a.* EXCLUDE (video_id), objects, actions, ql FROM e2 JOIN audio_windows a ON a.video_id=e2.video_id AND a.start_time<=timestamp+10 AND a.end_time>=timestamp-5),
  af AS (SELECT query_id, e2.video_id, bucket, a.* EXCLUDE (video_id, rk), objects, actions, ql FROM e2 JOIN (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_time, id) AS rk FROM audio_windows) a
    ON a.video_id=e2.video_id AND rk<=3 WHERE (query_id, e2.video_id, bucket) NOT IN (SELECT (query_id, video_id, bucket) FROM an)),
  au AS (SELECT query_id, video_id, bucket, least(1.0, max(len(list_intersect(list_distinct(list_concat(objects,actions)), [tag, dominant_source]))
      /greatest(len(list_intersect(list_distinct(list_concat(objects,actions)), ['music','singing','applause','laughter','cheering','crowd','gunshot','explosion','siren','silence','noise','typing','fast','slow','upbeat','dramatic','bass','loud','quiet','robotic','autotune','echo','reverb','pitch','speed'])),1))) AS audio_event_match,
    least(1.0, max(CASE WHEN regexp_matches(ql,'fast|upbeat') AND bpm>120 THEN 0.4 WHEN regexp_matches(ql,'slow|dramatic') AND bpm<80 THEN 0.4 ELSE 0 END
      +CASE WHEN regexp_matches(ql,'loud|bass') AND coalesce(loudness_lufs,-30)>-15 THEN 0.3 WHEN regexp_matches(ql,'quiet|soft') AND coalesce(loudness_lufs,-30)<-25 THEN 0.3 ELSE 0 END
      +CASE WHEN contains(ql,'music') AND harmonic_ratio>0.6 THEN 0.3 ELSE 0 END+CASE WHEN regexp_matches(ql,'robotic|autotune|speed|pitch|filter') AND overall_manipulation>0.3 THEN 0.4 ELSE 0 END)) AS audio_attribute_match
    FROM (SELECT * FROM an UNION ALL SELECT * FROM af) GROUP BY 1,2,3),
  al AS (SELECT query_id, e2.video_id, bucket, max(s.confidence) AS alignment_quality FROM e2 JOIN segments s ON s.video_id=e2.video_id AND s.start_time<=timestamp+15 AND s.end_time>=timestamp-5 GROUP BY 1,2,3),
  ch AS (SELECT query_id, e2.video_id, bucket, 1-min(abs(timestamp-start_time))/10 AS change_point_proximity FROM e2 JOIN audio_windows a ON a.video_id=e2.video_id AND music_probability>=0.3
    AND abs(timestamp-start_time)<10 GROUP BY 1,2,3),
  fz AS (SELECT query_id, video_id, bucket, timestamp, text, ocr, vtag, text_semantic, visual_similarity, ocr_match, keyword_match, 0.0::DOUBLE AS emotion_context, coalesce(cs,0) AS comment_semantic,
    CASE WHEN timestamp>0 AND abs(bt-timestamp)<30 THEN 0.8 ELSE 0 END AS comment_timestamp_boost, CASE WHEN cn>=3 THEN greatest(0,1-2*cv) ELSE 0 END AS agreement_cluster,
    coalesce(entity_overlap,0) AS entity_overlap, CASE WHEN ca>=5 THEN least(ca/20,1.0) ELSE 0 END AS user_cluster_confidence, coalesce(audio_event_match,0) AS audio_event_match,
    coalesce(audio_attribute_match,0) AS audio_attribute_match, coalesce(alignment_quality,0) AS alignment_quality, coalesce(change_point_proximity,0) AS change_point_proximity, confidence
    FROM e2 LEFT JOIN cm USING (query_id, video_id) LEFT JOIN eo USING (query_id, video_id) LEFT JOIN au USING (query_id, video_id, bucket) LEFT JOIN al USING (query_id, video_id, bucket)
    LEFT JOIN ch USING (query_id, video_id, bucket)),
  fc AS (SELECT *, least(0.3, 0.15*(CASE WHEN timestamp-lag(timestamp) OVER w<30 THEN 1 ELSE 0 END+CASE WHEN lead(timestamp) OVER w-timestamp<30 THEN 1 ELSE 0 END)) AS temporal_coherence FROM fz
    WINDOW w AS (PARTITION BY query_id, video_id ORDER BY timestamp, bucket)),
  ff AS (SELECT *, ({'+'.join(f'{m}*{w}' for m, w in W.items() if m != 'temporal_coherence')})*(0.7+0.3*confidence)+temporal_coherence*{W['temporal_coherence']} AS final_score FROM fc)"""])

SAID = f"""concat_ws(' | ', CASE WHEN text_semantic>0.3 THEN printf('Transcript semantically matches your query (score: %.2f)', {r('text_semantic', 2)}) END, CASE WHEN keyword_match>0 THEN 'Keywords found in transcript' END,
   CASE WHEN visual_similarity>0.2 THEN printf('Visual content matches (score: %.2f)', {r('visual_similarity', 2)}) END, CASE WHEN ocr_match>0 THEN 'On-screen text/numbers match: ' || chr(39) || substr(ocr,1,50) || chr(39) END,
   CASE WHEN temporal_coherence>0 THEN 'Surrounding segments also match (temporal coherence)' END)"""
RESULTS = f"""SELECT query_id, rank, f.video_id, v.title AS video_title, c.name AS channel_name, timestamp, CAST(floor({r('final_score', 4)}*1e4+0.5) AS BIGINT) AS score,
        v.url || '&t=' || CAST(floor(timestamp) AS BIGINT) || 's' AS video_url_with_timecode, v.view_count, substr(coalesce(text,''),1,300) AS transcript_snippet, coalesce(vtag,'') AS tags, nullif(coalesce(ocr,''),'') AS ocr_text,
        CASE WHEN {SAID}='' THEN 'Partial match across multiple signals' ELSE {SAID} END AS explanation FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {r('final_score', 6)} DESC, video_id, bucket) AS rank
        FROM ff WHERE text_semantic>=0.25 OR visual_similarity>=0.15 OR ocr_match>=0.3 OR keyword_match>=0) f JOIN videos v ON v.id=f.video_id LEFT JOIN channels c ON c.id=v.channel_id WHERE rank<=20"""

ORACLE = {
    "vector_topk": sql("vectors", """SELECT query_id, id, CAST(floor(score*1e4+0.5) AS BIGINT) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM tk QUALIFY rank<=20""", TOPK),
    "vector_topk_filtered": sql("vectors", """SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM tk WHERE collection<5 QUALIFY rank<=10""", TOPK),
    "collection_stats": sql("vectors", "SELECT collection, count(*) AS vectors, CAST(max(len(vector)) AS BIGINT) AS dim FROM vectors GROUP BY 1"),
    "vector_topk_blocks": sql("vectors", f"""SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
        SELECT q.id AS query_id, c.id, {score6('c.vector', 'q.vector')} AS score FROM vectors c CROSS JOIN vectors q) QUALIFY rank<=5"""),
    "near_duplicates": sql("vectors", """SELECT al.id, min(least(reach.y, rp.id)) AS component_id FROM al JOIN rp USING (vector) JOIN reach ON reach.x=rp.id GROUP BY 1""",
        """al AS (SELECT id, vector FROM vectors UNION ALL SELECT id+1000000, vector FROM vectors UNION ALL SELECT id+2000000,
          list_transform(vector, lambda x, i: CASE WHEN i=1 THEN (x+0.05::FLOAT)::FLOAT ELSE x END) FROM vectors)""",
        "rp AS (SELECT min(id) AS id, vector FROM al GROUP BY vector)",
        f"pr AS (SELECT x.id AS a, y.id AS b FROM rp x JOIN rp y ON x.id<>y.id AND {r(cos('x.vector', 'y.vector'), 6)}>=0.98)",
        "reach AS (SELECT id AS x, id AS y FROM rp UNION SELECT reach.x, pr.b FROM reach JOIN pr ON pr.a=reach.y)"),
    "zero_shot_labels": sql("vectors", f"""SELECT id, category, label, rank FROM (SELECT *, row_number() OVER (PARTITION BY id, category ORDER BY confidence DESC, label) AS rank FROM (
        SELECT id, category, label, {r('exp(s*5)/sum(exp(s*5)) OVER (PARTITION BY id, category)', 4)} AS confidence FROM (SELECT v.id, category, label, {cos('v.vector', 'l.lv')} AS s FROM vectors v CROSS JOIN lb l)))
        WHERE rank<=3 AND confidence>=0.06""",
        "vx AS (SELECT id%2 AS p, collection, unnest(vector) AS x, generate_subscripts(vector,1) AS i FROM vectors)",
        """lb AS (SELECT CASE WHEN p=0 THEN 'scene' ELSE 'object' END AS category, 'l' || collection AS label, list(x ORDER BY i) AS lv FROM (SELECT p, collection, i, avg(x) AS x FROM vx GROUP BY 1,2,3) GROUP BY 1,2)"""),
    "decompose_query": f"WITH {NATURAL}, {decompose('nat')} SELECT query_id, emotion, time_era, context, {', '.join(f'''array_to_string({c},'|') AS {c}''' for c in ('numbers', 'actions', 'objects', 'keywords'))} FROM de",
    "sub_queries": f"""WITH {NATURAL}, {decompose('nat')} SELECT query_id, array_to_string(keywords,' ') AS keyword, CASE WHEN len(numbers)>0 THEN array_to_string(numbers,' ') END AS ocr,
        CASE WHEN len(objects)>0 THEN array_to_string(objects,' ') END AS visual, emotion FROM de""",
    "fused_scores": sql("vectors audio_windows segments", "SELECT query_id, video_id, bucket, " + ", ".join(f"CAST(floor(({m})*1e5+0.500001) AS BIGINT) AS {m}" for m in [*W, "final_score"]) + " FROM ff", ENTRIES),
    "search": sql("vectors audio_windows segments videos channels", RESULTS, ENTRIES),
    "search_filtered": sql("vectors audio_windows segments videos channels", RESULTS, ENTRIES.replace(
        "FROM cp0 WHERE true", "FROM cp0 WHERE confidence>=0.3 AND video_id IN (SELECT id FROM videos WHERE language='en' AND view_count>=50000)")),
    "recalibrate_weights": sql("feedback", f"""SELECT m AS modality, {r('w2/sum(w2) OVER ()', 4)} AS weight FROM (SELECT m, CASE WHEN ratio<0.6 THEN CASE WHEN m='text_semantic' THEN greatest(w-0.02,0.05) ELSE least(w+0.005,0.5) END ELSE w END AS w2
        FROM (VALUES ('text_semantic',0.20::DOUBLE),('visual_similarity',0.12),('ocr_match',0.08),('keyword_match',0.07),('temporal_coherence',0.05),('emotion_context',0.02)) t(m,w)
        CROSS JOIN (SELECT count(*) FILTER (WHERE feedback_type='upvote')/greatest(count(*) FILTER (WHERE feedback_type IN ('upvote','downvote')),1) AS ratio,
          count(*) FILTER (WHERE created_at>=TIMESTAMP '2024-01-31'-INTERVAL 7 DAY) AS n FROM feedback) WHERE n>=10)"""),
    "precision_at_k": sql("feedback", f"""SELECT {r('avg(p1)', 4)} AS precision_at_1, {r('avg(p5)', 4)} AS precision_at_5 FROM (SELECT query_text, count(*) FILTER (WHERE rk=1 AND up)/1 AS p1, count(*) FILTER (WHERE rk<=5 AND up)/5 AS p5 FROM (
        SELECT query_text, bool_or(feedback_type='upvote') AS up, row_number() OVER (PARTITION BY query_text ORDER BY count(*) DESC, video_id) AS rk FROM feedback GROUP BY query_text, video_id) GROUP BY 1)"""),
}
