"""Named queries over the supplied tables: comments, threads, conversation measures."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import comments as C
from ..operators.trees import ancestor_closure
from ..sources import adapters as A
from .models_sql import clip, r, raw_words, sql, words

TOPICS = ["technology", "science", "gaming", "music", "sports"]


def with_entities(spark, d):
    """Comments with long words standing in for recognised entities."""
    long = F.array_distinct(F.filter(T.raw_words("text"), lambda w: F.length(w) >= 8))
    return A.comments(spark, d).withColumn("entities", F.transform(long, lambda w: F.struct(
        w.alias("name"), F.when(F.length(w) % 2 == 0, "PERSON").otherwise("ORG").alias("type"))))


def few_authors(spark, d):
    """The comments spread over eleven authors, so that pairs answer each other often."""
    return A.comments(spark, d).withColumn("author_id", F.concat(F.lit("u"), F.col("id") * F.col("id") % 11))


def known_authors(spark, d):
    return A.comments(spark, d).filter("video_id = 0").groupBy(F.lit("youtube").alias("platform"), "author_id").agg(
        F.lit(5).cast("long").alias("comment_count"), F.timestamp_seconds(F.lit(1600000000)).alias("first_seen_at"),
        F.timestamp_seconds(F.lit(1700000000)).alias("last_seen_at"))


def q_full_threads(s, d):
    return C.full_threads(A.comments(s, d))


def q_ingest_stats(s, d):
    raw = A.raw_comments(s, d)
    return C.ingest_stats(raw, C.build_threads(raw), known_authors(s, d).select("platform", "author_id"))


QUERIES = {
    "build_threads": lambda s, d: C.build_threads(A.raw_comments(s, d)).select(
        "platform_comment_id", "parent_comment_id", "root_thread_id", "depth_level", "author_id", "like_count"),
    "ingest_stats": q_ingest_stats,
    "resolve_authors": lambda s, d: C.resolve_authors(C.build_threads(A.raw_comments(s, d)), known_authors(s, d)),
    "full_threads": q_full_threads,
    "descendants": lambda s, d: C.descendants(A.comments(s, d), C.roots(A.comments(s, d))),
    "parent_chain": lambda s, d: C.parent_chain(A.comments(s, d), C.leaves(A.comments(s, d))),
    "ancestor_closure": lambda s, d: ancestor_closure(A.comments(s, d)),
    "most_branched": lambda s, d: C.most_branched(A.comments(s, d)).drop("text"),
    "longest_chains": lambda s, d: C.longest_chains(A.comments(s, d)),
    "debate_clusters": lambda s, d: C.debate_clusters(A.comments(s, d)),
    "thread_analysis": lambda s, d: C.thread_analysis(A.comments(s, d)),
    "replied_to_edges": lambda s, d: C.replied_to(A.comments(s, d)),
    "user_loops": lambda s, d: C.user_loops(C.replied_to(few_authors(s, d))),
    "user_overlap": lambda s, d: C.user_overlap(A.comments(s, d), "user_3"),
    "debate_chains": lambda s, d: C.debate_chains(A.comments(s, d)).withColumn("key_topics", F.array_join("key_topics", ",")),
    "user_profiles": lambda s, d: C.user_profiles(A.comments(s, d), TOPICS).select(
        "author_id", "comment_count", "positivity_baseline", "positivity_std", "engagement_velocity", "cross_video_loyalty",
        "avg_comment_length", "reply_ratio", "confidence", F.array_join("hour_counts", ",").alias("hour_counts"),
        F.array_join("top_topics", ",").alias("top_topics"), F.col("topic_vector")[0].alias("technology"),
        F.col("topic_vector")[2].alias("gaming"), F.col("topic_vector")[4].alias("sports")),
    "community_metrics": lambda s, d: C.community_metrics(A.comments(s, d)),
    "community_metrics_by_channel": lambda s, d: C.community_metrics(A.comments(s, d), "channel_id"),
    "nlp_annotate": lambda s, d: C.nlp_annotate(A.comments(s, d), toxic_at=0.1).select(
        "id", F.array_join("extracted_timestamps", "|").alias("stamps"), F.array_join("extracted_numbers", "|").alias("numbers"),
        F.size("ts_seconds").cast("long").alias("n_seconds"), F.col("spam_score"), F.col("toxicity_score"), "status"),
    "annotation_stats": lambda s, d: C.annotation_stats(C.nlp_annotate(A.comments(s, d), toxic_at=0.1)),
    "entity_mentions": lambda s, d: C.entity_mentions(with_entities(s, d)).drop("ts"),
    "echo_chambers": lambda s, d: C.echo_chambers(A.comments(s, d)),
    "sentiment_cascades": lambda s, d: C.sentiment_cascades(A.comments(s, d), min_size=2),
    "authority": lambda s, d: C.authority(A.comments(s, d)),
}

RAW = """raw AS (SELECT id, 'youtube:' || id AS k, CASE WHEN parent_comment_id IS NULL THEN NULL ELSE 'youtube:' || parent_comment_id END AS p,
   author_id, video_id, CASE WHEN id%13=5 THEN '' ELSE trim(text) END AS t, like_count, timestamp_posted FROM comments)"""
THREADS = RAW + """, t AS (SELECT k, p, k AS root, CAST(0 AS BIGINT) AS depth, author_id, like_count, timestamp_posted, video_id FROM raw WHERE p IS NULL AND t<>''
   UNION ALL SELECT raw.k, raw.p, t.root, t.depth+1, raw.author_id, raw.like_count, raw.timestamp_posted, raw.video_id
   FROM raw JOIN t ON raw.p=t.k WHERE raw.t<>'' AND t.depth<20)"""
CLOSURE = """cl AS (SELECT id AS descendant, parent_comment_id AS ancestor, CAST(1 AS BIGINT) AS distance FROM comments WHERE parent_comment_id IS NOT NULL
   UNION ALL SELECT cl.descendant, c.parent_comment_id, cl.distance+1 FROM cl JOIN comments c ON cl.ancestor=c.id WHERE c.parent_comment_id IS NOT NULL)"""
KNOWN = """known AS (SELECT DISTINCT author_id FROM comments WHERE video_id=0)"""
EDGES = """e AS (SELECT c.author_id AS source, p.author_id AS target, count(*) AS count FROM comments c JOIN comments p ON c.parent_comment_id=p.id
   WHERE c.author_id<>p.author_id GROUP BY 1,2)"""


def few_edges():
    return EDGES.replace("c.author_id", "'u' || (c.id*c.id%11)").replace("p.author_id", "'u' || (p.id*p.id%11)")


S = "coalesce(sentiment_score,0)"


def community(by):
    return sql("comments", f"""
  SELECT b.{by}, {r('CASE WHEN n>10 THEN least(1.0, 2*least(pos,neg)/n) ELSE 0 END', 3)} AS polarization_index,
    {r('least(1.0, coalesce(memes,0)/greatest(n*0.1,1.0))', 3)} AS meme_velocity,
    {r('least(1.0, coalesce(topics,0)/greatest(n*0.05,1.0))', 3)} AS narrative_divergence_score,
    {r('1-least(1.0, coalesce(topics,0)/greatest(n*0.05,1.0))', 3)} AS topic_convergence_speed,
    {r('tox', 3)} AS toxicity_ratio, {r('1-tox', 3)} AS constructive_ratio, people AS unique_participant_count,
    {r('depth', 2)} AS avg_thread_depth, {r('least(1.0, coalesce(pairs,0)*2/greatest(people,1))', 3)} AS reply_reciprocity,
    {r('least(0.85, 0.2+n*0.002)', 3)} AS confidence
  FROM b LEFT JOIN m USING ({by}) LEFT JOIN tp USING ({by}) LEFT JOIN pr USING ({by})""",
        f"""b AS (SELECT {by}, count(*) AS n, count(*) FILTER (WHERE {S}>0.2) AS pos, count(*) FILTER (WHERE {S}<-0.2) AS neg,
     coalesce(avg(toxicity_score),0) AS tox, count(DISTINCT author_id) AS people, avg(depth_level) AS depth FROM comments GROUP BY 1)""",
        f"w AS (SELECT {by}, {words('text')} AS w FROM comments)",
        f"g AS (SELECT {by}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS gram FROM w WHERE len(w)>1)",
        f"m AS (SELECT {by}, count(*) AS memes FROM (SELECT {by}, gram FROM g GROUP BY 1,2 HAVING count(*)>3) GROUP BY 1)",
        f"tp AS (SELECT {by}, count(DISTINCT t) AS topics FROM (SELECT {by}, unnest(topic_labels) AS t FROM comments) GROUP BY 1)",
        f"""pr AS (SELECT c.{by}, count(DISTINCT least(c.author_id,p.author_id) || '|' || greatest(c.author_id,p.author_id)) AS pairs
     FROM comments c JOIN comments p ON c.parent_comment_id=p.id AND c.{by}=p.{by} GROUP BY 1)""")


SPAM = "({}CASE WHEN len({})<=2 THEN 0.1 ELSE 0.0 END)"
SPAM_SQL = "least(1.0, " + "+".join(
    f"CASE WHEN regexp_matches(text, '{p}') THEN 0.25 ELSE 0.0 END" for p in [
        "(?i)(subscribe|sub to|check out my|follow me|promo code)", r"(?i)(free\s+(?:v-?bucks|gift|iphone|money))",
        r"(?i)(https?://\S+){2,}", r"[A-Z\s]{30,}"]) + \
    f"+CASE WHEN len(list_filter(range(1, length(text)-6), lambda i: text[i]<>chr(10) AND substr(text, i, 8)=repeat(text[i], 8)))>0 THEN 0.25 ELSE 0.0 END" \
    f"+CASE WHEN len({raw_words('text')})<=2 THEN 0.1 ELSE 0.0 END)"
MARKS = "(length(text)-length(replace(text,'!',''))+length(text)-length(replace(text,'?','')))"
TOX_SQL = (f"(CASE WHEN length(text)>10 AND length(regexp_replace(text,'[^\\p{{Lu}}]','','g'))/greatest(length(text),1)>0.6 THEN 0.3 ELSE 0.0 END"
           f"+CASE WHEN {MARKS}>5 THEN 0.2 ELSE 0.0 END+CASE WHEN len({raw_words('text')})<=3 AND {MARKS}>0 THEN 0.1 ELSE 0.0 END)")
STAMPS = [r"\b\d{1,2}:\d{2}:\d{2}\b", r"\b\d{1,2}:\d{2}\b", r"(?i)\bat\s+\d+\s*(?:min(?:ute)?s?)\b", r"(?i)\b\d+\s*(?:sec(?:ond)?s?)\b"]
STAMP_LIST = "list_concat(list_concat({},{}),list_concat({},{}))".format(*[f"regexp_extract_all(text,'{p}')" for p in STAMPS])
ANNOTATED = f"""an AS (SELECT id, {STAMP_LIST} AS st, regexp_extract_all(text, '\\b\\d[\\d,.:]*\\d|\\b\\d+\\b') AS nu,
   {SPAM_SQL} AS spam_score, {TOX_SQL} AS toxicity_score FROM comments)"""
STATUS = "CASE WHEN spam_score>=0.75 THEN 'spam' WHEN toxicity_score>=0.1 THEN 'toxic' ELSE 'processed' END"

ORACLE = {
    "build_threads": sql("comments", """SELECT k AS platform_comment_id, p AS parent_comment_id, root AS root_thread_id, depth AS depth_level,
        author_id, like_count FROM t""", THREADS),
    "ingest_stats": sql("comments", """SELECT 'fetched' AS stat, count(*) AS v FROM raw UNION ALL SELECT 'new', count(*) FROM t
        UNION ALL SELECT 'spam_filtered', 0 UNION ALL SELECT 'authors_discovered', count(DISTINCT author_id) FROM t
        WHERE author_id NOT IN (SELECT author_id FROM known)""", THREADS, KNOWN),
    "resolve_authors": sql("comments", """SELECT 'youtube' AS platform, author_id, CAST(sum(c) AS BIGINT) AS comment_count, min(f) AS first_seen_at,
        max(l) AS last_seen_at FROM (SELECT author_id, count(*) AS c, min(timestamp_posted) AS f, max(timestamp_posted) AS l FROM t GROUP BY 1
        UNION ALL SELECT author_id, 5, make_timestamp(1600000000000000), make_timestamp(1700000000000000) FROM known) GROUP BY 2""", THREADS, KNOWN),
    "full_threads": sql("comments", """SELECT root_thread_id, id, parent_comment_id, author_id, depth_level, timestamp_posted,
        count(*) OVER (PARTITION BY root_thread_id) AS total_comments, max(depth_level) OVER (PARTITION BY root_thread_id) AS max_depth FROM comments"""),
    "descendants": sql("comments", """SELECT ancestor AS comment_id, descendant AS reply_id, distance, author_id, timestamp_posted
        FROM cl JOIN comments c ON c.id=cl.descendant WHERE ancestor%100=0""", CLOSURE),
    "parent_chain": sql("comments", """SELECT descendant AS comment_id, ancestor AS ancestor_id, distance, author_id, text FROM cl JOIN comments c ON c.id=cl.ancestor
        WHERE descendant NOT IN (SELECT parent_comment_id FROM comments WHERE parent_comment_id IS NOT NULL)""", CLOSURE),
    "ancestor_closure": sql("comments", "SELECT * FROM cl", CLOSURE),
    "most_branched": sql("comments", """SELECT * FROM (SELECT video_id, p.id, depth_level, child_count,
        CAST(row_number() OVER (PARTITION BY video_id ORDER BY child_count DESC, p.id) AS INT) AS rank FROM comments p JOIN
        (SELECT parent_comment_id AS id, count(*) AS child_count FROM comments WHERE parent_comment_id IS NOT NULL GROUP BY 1) k USING (id)) WHERE rank<=10"""),
    "longest_chains": sql("comments", """SELECT * FROM (SELECT video_id, root_thread_id AS root_id, id AS leaf_id, depth_level AS chain_length,
        CAST(row_number() OVER (PARTITION BY video_id ORDER BY depth_level DESC, id) AS INT) AS rank FROM comments WHERE parent_comment_id IS NOT NULL
        AND id NOT IN (SELECT parent_comment_id FROM comments WHERE parent_comment_id IS NOT NULL)) WHERE rank<=10"""),
    "debate_clusters": sql("comments", f"""SELECT video_id, root_id, reply_count, avg_sentiment, debate_score, max_depth,
        CAST(row_number() OVER (PARTITION BY video_id ORDER BY debate_score DESC, root_id) AS INT) AS rank FROM (
        SELECT min(video_id) AS video_id, ancestor AS root_id, count(*) AS reply_count, {r('avg(sentiment_score)', 2)} AS avg_sentiment,
        {r('stddev_samp(sentiment_score)', 2)} AS debate_score, max(distance) AS max_depth FROM cl JOIN comments c ON c.id=cl.descendant
        WHERE ancestor IN (SELECT id FROM comments WHERE parent_comment_id IS NULL) GROUP BY ancestor HAVING count(*)>=3 AND max(distance)>=3)
        QUALIFY rank<=20""", CLOSURE),
    "thread_analysis": sql("comments", f"""SELECT root_thread_id, count(*) AS total_comments,
        count(DISTINCT CASE WHEN parent_comment_id IS NOT NULL THEN author_id END) AS unique_authors,
        coalesce({r(f'avg(CASE WHEN parent_comment_id IS NOT NULL THEN {S} END)', 3)},0) AS avg_sentiment, max(depth_level) AS max_depth,
        coalesce({r('stddev_samp(CASE WHEN parent_comment_id IS NOT NULL THEN sentiment_score END)', 3)},0) AS debate_score,
        max(mb) AS most_branched_depth, max(depth_level) AS longest_chain_length FROM comments LEFT JOIN (
          SELECT root_thread_id, depth_level AS mb FROM comments p JOIN (SELECT parent_comment_id AS id, count(*) AS n FROM comments
          WHERE parent_comment_id IS NOT NULL GROUP BY 1) k USING (id) QUALIFY row_number() OVER (PARTITION BY root_thread_id ORDER BY n DESC, id)=1)
        USING (root_thread_id) GROUP BY 1"""),
    "replied_to_edges": sql("comments", "SELECT * FROM e", EDGES),
    "user_loops": sql("comments", """SELECT x.source AS user_a, x.target AS user_b, x.count AS a_to_b, y.count AS b_to_a, x.count+y.count AS total_exchanges
        FROM e x JOIN e y ON x.source=y.target AND x.target=y.source WHERE x.source<x.target AND x.count>=3 AND y.count>=3
        ORDER BY 5 DESC, 1, 2 LIMIT 50""", few_edges()),
    "user_overlap": sql("comments", """SELECT author_id, count(DISTINCT video_id) AS shared_videos FROM comments WHERE author_id<>'user_3'
        AND video_id IN (SELECT video_id FROM comments WHERE author_id='user_3') GROUP BY 1 HAVING count(DISTINCT video_id)>=2 ORDER BY 2 DESC, 1 LIMIT 20"""),
    "debate_chains": sql("comments", f"""SELECT root AS root_comment_id, video_id, participant_count, n AS turn_count, {r('spread', 3)} AS sentiment_polarity_range,
        {r(clip('(sd2-sd1)/greatest(sd1,0.01)'), 3)} AS escalation_score, CASE WHEN n>10 AND abs(last)<0.1 THEN 'consensus'
        WHEN n>6 AND last_depth=0 THEN 'abandoned' ELSE 'unresolved' END AS resolution, {r('least(0.8,0.3+n*0.02)', 3)} AS confidence,
        coalesce(kt,'') AS key_topics FROM (SELECT root, max(n) AS n, min(video_id) AS video_id, count(DISTINCT author_id) AS participant_count,
          max(s)-min(s) AS spread, CASE WHEN max(n)//2>2 THEN stddev_pop(s) FILTER (WHERE pos<n//2) ELSE 0 END AS sd1,
          CASE WHEN max(n)-max(n)//2>2 THEN stddev_pop(s) FILTER (WHERE pos>=n//2) ELSE 0 END AS sd2,
          arg_max(s,pos) AS last, arg_max(depth_level,pos) AS last_depth FROM o GROUP BY root) LEFT JOIN tt USING (root)
        WHERE n>=4 AND participant_count>=2 AND spread>=0.3""",
        f"""o AS (SELECT root_thread_id AS root, {S} AS s, author_id, video_id, depth_level, count(*) OVER (PARTITION BY root_thread_id) AS n,
          row_number() OVER (PARTITION BY root_thread_id ORDER BY timestamp_posted, id)-1 AS pos FROM comments)""",
        """tt AS (SELECT root, string_agg(t, ',' ORDER BY rk) AS kt FROM (SELECT root, t, row_number() OVER (PARTITION BY root ORDER BY count(*) DESC, t) AS rk
          FROM (SELECT root_thread_id AS root, unnest(topic_labels) AS t FROM comments) GROUP BY 1,2) WHERE rk<=3 GROUP BY 1)"""),
    "user_profiles": sql("comments", f"""SELECT author_id, count(*) AS comment_count, {r(f'avg({S})', 3)} AS positivity_baseline,
        {r(f'stddev_pop({S})', 3)} AS positivity_std,
        {r("CASE WHEN count(*)>1 THEN count(*)/greatest((epoch(max(timestamp_posted))-epoch(min(timestamp_posted)))/86400.0,1.0) ELSE 0 END", 3)} AS engagement_velocity,
        {r('1.0/count(DISTINCT channel_id)', 3)} AS cross_video_loyalty, {r('avg(length(text))', 1)} AS avg_comment_length,
        {r('count(parent_comment_id)/count(*)', 3)} AS reply_ratio, {r('least(0.85,0.2+count(*)*0.01)', 3)} AS confidence,
        array_to_string([{','.join(f'count(*) FILTER (WHERE hour(timestamp_posted)={h})' for h in range(24))}], ',') AS hour_counts,
        any_value(tt) AS top_topics, any_value(v0) AS technology, any_value(v2) AS gaming, any_value(v4) AS sports
        FROM comments LEFT JOIN tt USING (author_id) LEFT JOIN tv USING (author_id) GROUP BY 1""",
        "x AS (SELECT author_id, unnest(topic_labels) AS t FROM comments)",
        """tt AS (SELECT author_id, string_agg(t, ',' ORDER BY rk) AS tt FROM (SELECT author_id, t,
          row_number() OVER (PARTITION BY author_id ORDER BY count(*) DESC, t) AS rk FROM x GROUP BY 1,2) WHERE rk<=5 GROUP BY 1)""",
        "tv AS (SELECT author_id, " + ", ".join(f"{r(f'count(*) FILTER (WHERE t={chr(39)}{TOPICS[i]}{chr(39)})/count(*)', 4)} AS v{i}" for i in (0, 2, 4))
        + " FROM x GROUP BY 1)"),
    "community_metrics": community("video_id"),
    "community_metrics_by_channel": community("channel_id"),
    "nlp_annotate": sql("comments", f"""SELECT id, array_to_string(st,'|') AS stamps, array_to_string(nu,'|') AS numbers, len(st) AS n_seconds,
        CAST(spam_score AS DOUBLE) AS spam_score, CAST(toxicity_score AS DOUBLE) AS toxicity_score, {STATUS} AS status FROM an""", ANNOTATED),
    "annotation_stats": sql("comments", f"""SELECT count(*) FILTER (WHERE {STATUS}='processed') AS processed, count(*) FILTER (WHERE {STATUS}='spam') AS spam,
        count(*) FILTER (WHERE {STATUS}='toxic') AS toxic FROM an""", ANNOTATED),
    "entity_mentions": sql("comments", f"""SELECT lower(trim(w)) AS canonical_name, CASE WHEN length(w)%2=0 THEN 'person' ELSE 'organization' END AS entity_type,
        video_id, 'comment' AS source_type, id AS source_id, substr(text,1,200) AS context_text FROM (SELECT *,
        unnest(list_distinct(list_filter({raw_words('text')}, lambda q: length(q)>=8))) AS w FROM comments) WHERE length(trim(w))>=2"""),
    "echo_chambers": sql("comments", f"""SELECT community_id, member_count, coalesce(replies,0) AS replies, {r('coalesce(inside/replies,0)', 4)} AS insularity
        FROM big LEFT JOIN (SELECT m.community_id, count(*) AS replies, count(*) FILTER (WHERE m2.community_id=m.community_id) AS inside
          FROM comments c JOIN comments p ON c.parent_comment_id=p.id JOIN mem m ON m.id=c.author_id LEFT JOIN mem m2 ON m2.id=p.author_id GROUP BY 1)
        USING (community_id)""",
        f"mood AS (SELECT author_id, avg({S}) AS m FROM comments GROUP BY 1)",
        "ac AS (SELECT DISTINCT author_id, root_thread_id FROM comments)",
        """pr AS (SELECT x.author_id AS a, y.author_id AS b FROM ac x JOIN ac y ON x.root_thread_id=y.root_thread_id AND x.author_id<y.author_id
          GROUP BY 1,2 HAVING count(*)>=2)""",
        "nr AS (SELECT a, b FROM pr JOIN mood x ON x.author_id=a JOIN mood y ON y.author_id=b WHERE abs(x.m-y.m)<=0.2+1e-9)",
        "und AS (SELECT a, b FROM nr UNION SELECT b, a FROM nr)",
        "reach AS (SELECT a AS id, a AS c FROM und UNION SELECT reach.id, und.b FROM reach JOIN und ON reach.c=und.a)",
        "lab AS (SELECT id, min(c) AS community_id FROM reach GROUP BY 1)",
        "big AS (SELECT community_id, count(*) AS member_count FROM lab GROUP BY 1 HAVING count(*)>=3)",
        "mem AS (SELECT id, community_id FROM lab JOIN big USING (community_id))"),
    "sentiment_cascades": sql("comments", f"""SELECT root_thread_id, first_comment_id, CASE WHEN sign>0 THEN 'positive' ELSE 'negative' END AS direction,
        cascade_size, {r('(epoch(t1)-epoch(t0))/60.0', 2)} AS minutes, {r('peak', 3)} AS peak_intensity, {r('(a-z)/cascade_size', 4)} AS damping,
        min(sign) OVER (PARTITION BY root_thread_id)<>max(sign) OVER (PARTITION BY root_thread_id) AS controversy FROM (
        SELECT root_thread_id, sign, island, count(*) AS cascade_size, min(timestamp_posted) AS t0, max(timestamp_posted) AS t1, max(abs(s)) AS peak,
          abs(arg_min(s,pos)) AS a, abs(arg_max(s,pos)) AS z, arg_min(id,pos) AS first_comment_id FROM o2 WHERE sign<>0 GROUP BY 1,2,3 HAVING count(*)>=2)""",
        f"""o1 AS (SELECT root_thread_id, id, timestamp_posted, {S} AS s, CASE WHEN {S}>0.2 THEN 1 WHEN {S}<-0.2 THEN -1 ELSE 0 END AS sign,
          row_number() OVER (PARTITION BY root_thread_id ORDER BY timestamp_posted, id) AS pos FROM comments)""",
        "o2 AS (SELECT *, pos-row_number() OVER (PARTITION BY root_thread_id, sign ORDER BY pos) AS island FROM o1)"),
    "authority": sql("comments", f"""SELECT *, {r('CASE WHEN acknowledged+challenged>0 THEN acknowledged/(acknowledged+challenged) END', 4)} AS authority_score
        FROM (SELECT p.video_id, p.author_id, count(*) FILTER (WHERE coalesce(c.sentiment_score,0)>0.2) AS acknowledged,
        count(*) FILTER (WHERE coalesce(c.sentiment_score,0)<-0.2) AS challenged FROM comments c JOIN comments p ON c.parent_comment_id=p.id GROUP BY 1,2)"""),
}
