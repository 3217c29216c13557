"""Named queries: one per column function."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions import urls as U
from ..functions.lexicons import ASR_FILLERS, CONFIDENCE_BANDS, PRIORITY_RULES
from ..functions.numbers import rnd
from ..sources import adapters as A
from .models_sql import clip, in_list, r, raw_words, sql, words

# address forms that a page number turns into one url each
STEMS = [
    "https://www.youtube.com/@", "https://youtube.com/channel/", "https://youtu.be/", "https://www.tiktok.com/@", "https://vm.tiktok.com/",
    "https://twitter.com/", "https://x.com/i/", "https://www.instagram.com/p/", "https://instagram.com/user", "https://twitch.tv/videos/",
    "https://www.twitch.tv/Chan", "https://vimeo.com/", "https://dai.ly/", "https://old.reddit.com/r/", "https://fb.watch/", "https://b23.tv/",
    "https://youtube.com/playlist?list=", "https://example.org/shorts/",
]


def links(s, d):
    """Every page with a platform address built from its id."""
    stem = F.element_at(F.array(*[F.lit(x) for x in STEMS]), (F.col("page_id") % len(STEMS) + 1).cast("int"))
    return A.table(s, d, "pages").select("page_id", F.concat(stem, F.col("page_id").cast("string"), F.when(F.col("page_id") % 5 == 0, "/").otherwise("")).alias("link"))


def quoted(s, d):
    """Conversation texts that quote times."""
    m, c = F.lpad((F.col("turn") * 7 % 60).cast("string"), 2, "0"), A.table(s, d, "conversations")
    extra = F.format_string(" At %d minutes, %d:%s then 1:%s:45 and %d seconds, 1,234.5", F.col("turn"), F.col("conv_id") % 60, m, m, F.col("turn") * 3)
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat("text", extra).alias("t"), (F.col("conv_id") * F.col("turn") % 150).alias("likes"))


def spammy(s, d):
    """Comments prefixed by one of a few advertising forms, some of them short."""
    form = F.element_at(F.array(*[F.lit(x) for x in SPAM_FORMS]), (F.col("id") % len(SPAM_FORMS) + 1).cast("int"))
    c = A.comments(s, d)
    return c.select("id", F.concat(form, F.col("text")).alias("t"), "like_count")


SPAM_FORMS = ["", "sub", "Subscribe now ", "check out my http://a.b http://c.d ", "FREE gift FREE GIFT ", "wooooooooooow ", "WHY WHY WHY??!!!! ", "hi! ",
              "PROMO CODE PROMO CODE PROMO CODE NOW ", "free iphone "]


def spans(s, d):
    """Whole segment texts, with a repeated opening, a repeated word or fillers added to three quarters of them."""
    t = F.when(F.col("id") % 4 == 0, F.concat(F.repeat(F.substring("text", 1, 12), 5), F.lit(" "), "text")).when(F.col("id") % 4 == 1, F.concat(F.col("text"), F.lit(" "), F.repeat(F.lit("yes "), 9), F.lit("no")))
    t = t.when(F.col("id") % 4 == 2, F.concat(F.lit("Um like "), "text")).otherwise(F.col("text"))
    return A.segments(s, d).select("id", t.alias("t"), "start_time", F.when(F.col("id") % 9 == 0, F.col("start_time") - 1).otherwise(F.col("end_time")).alias("end_time"))


def levels(s, d):
    return A.audio_windows(s, d)


QUERIES = {
    "detect_platform": lambda s, d: links(s, d).select("page_id", U.detect_platform("link").alias("platform")),
    "channel_key": lambda s, d: links(s, d).select("page_id", U.channel_key("link", U.detect_platform("link")).alias("channel_key")),
    "canonical_url": lambda s, d: links(s, d).select("page_id", U.canonical_url(
        "page_id", F.when(F.col("page_id") % 4 == 0, None).otherwise(F.col("link")), U.detect_platform("link")).alias("url")),
    "timecoded_url": lambda s, d: links(s, d).select("page_id", U.timecoded_url("link", F.col("page_id") * 37.7).alias("url")),
    "url_job_type": lambda s, d: links(s, d).select("page_id", U.url_job_type("link").alias("job")),
    "comment_key": lambda s, d: A.comments(s, d).select("id", T.comment_key(
        F.lit("youtube"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")), "author_id", "text", F.col("like_count")).alias("key")),
    "parse_posted": lambda s, d: A.comments(s, d).select("id", T.parse_posted(
        F.when(F.col("id") % 3 == 0, (F.col("id") + 1704067200).cast("string"))
        .when(F.col("id") % 3 == 1, F.concat(F.date_format("timestamp_posted", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise("yesterday")).alias("posted")),
    "extract_timestamps": lambda s, d: quoted(s, d).withColumn("x", T.extract_timestamps("t")).select(
        "id", F.array_join("x.raw", "|").alias("raw"), F.array_join(F.transform("x.seconds", lambda v: v.cast("long").cast("string")), "|").alias("seconds")),
    "extract_numbers": lambda s, d: quoted(s, d).select("id", F.array_join(T.extract_numbers("t"), "|").alias("numbers")),
    "quick_spam": lambda s, d: spammy(s, d).select("id", rnd(T.quick_spam("t", "like_count"), 4).alias("score")),
    "spam_score": lambda s, d: spammy(s, d).select("id", rnd(T.spam_score("t"), 4).alias("score")),
    "toxicity_score": lambda s, d: spammy(s, d).select("id", rnd(T.toxicity_score("t"), 4).alias("score")),
    "comment_status": lambda s, d: A.comments(s, d).select("id", T.comment_status(F.col("like_count") / 150, "toxicity_score").alias("status")),
    "sentiment_signed": lambda s, d: A.comments(s, d).withColumn("x", T.sentiment_signed("sentiment_label", F.abs("sentiment_score"))).select("id", "x.score", "x.label"),
    "entity_type_map": lambda s, d: A.comments(s, d).select("id", T.entity_type(F.element_at(
        F.array(*[F.lit(x) for x in ("PERSON", "ORG", "GPE", "LOC", "PRODUCT", "EVENT", "WORK_OF_ART", "FAC", "NORP", "LAW", "DATE")]),
        (F.col("id") % 11 + 1).cast("int"))).alias("kind")),
    "clean_filler": lambda s, d: spans(s, d).select("id", T.clean_filler("t").alias("t")),
    "is_hallucination": lambda s, d: spans(s, d).select("id", T.is_hallucination("t", "start_time", "end_time").alias("bad")),
    "crawl_priority": lambda s, d: A.videos(s, d).join(A.channels(s, d).select(F.col("id").alias("channel_id"), "priority_tier"), "channel_id").select(
        "id", S.crawl_priority("view_count", "duration_seconds", "uploaded_at", F.concat("title", F.when(F.col("id") % 2 == 0, " Tutorial: how to REVIEW").otherwise("")),
                               "like_count", "priority_tier", "2001-08-02").alias("priority")),
    "confidence_band": lambda s, d: levels(s, d).withColumn("b", S.confidence_band(F.col("music_probability") * 1.3 - 0.1)).select(
        "id", rnd("b.probability", 4).alias("probability"), "b.band", "b.label", "b.colour"),
    "band_from_value": lambda s, d: levels(s, d).withColumn("b", S.band_from_value("harmonic_ratio", 0.2)).select("id", "b.value", "b.lower", "b.upper", "b.method"),
    "overall_manipulation": lambda s, d: levels(s, d).select("id", rnd(S.overall_manipulation(
        "music_probability", "speech_probability", "harmonic_ratio", "zero_crossing_rate", "overall_manipulation", F.col("dynamic_range_db") / 20), 6).alias("score")),
    "lufs_levels": lambda s, d: levels(s, d).select("id", rnd(S.lufs_to_linear("loudness_lufs"), 6).alias("linear"),
                                                    rnd(S.energy("loudness_lufs", "speech_probability"), 6).alias("energy")),
    "uploaded_at": lambda s, d: A.videos(s, d).select("id", T.uploaded_at(
        F.when(F.col("id") % 5 == 0, "notadate").otherwise(F.date_format("uploaded_at", "yyyyMMdd"))).alias("uploaded")),
    "vector_hash": lambda s, d: A.vectors(s, d).select("id", T.vector_hash(F.transform("vector", lambda x: F.floor(x * F.lit(1000).cast("float")))).alias("hash")),
    "node_id_label": lambda s, d: A.videos(s, d).select(
        "id", T.node_id(F.when(F.col("id") % 2 == 0, ""), F.when(F.col("id") % 3 == 0, F.col("title")), "id").alias("node_id"),
        T.node_label(F.lit("Video"), F.when(F.col("id") % 4 == 0, F.repeat("title", 6)), F.when(F.col("id") % 4 == 1, F.col("platform"))).alias("label")),
    "hours_since": lambda s, d: A.videos(s, d).select("id", S.hours_since(
        F.when(F.col("id") % 5 == 0, "broken").otherwise(F.col("uploaded_at").cast("string")), "2001-08-02").alias("hours")),
    "l2_normalize": lambda s, d: A.vectors(s, d).withColumn("v", S.l2_normalize("vector")).select("id", rnd(F.col("v")[0], 6).alias("v0"), rnd(S.norm(F.col("v")), 6).alias("norm")),
}

LINKS = "links AS (SELECT page_id, [" + ",".join(f"'{x}'" for x in STEMS) + f"][page_id%{len(STEMS)}+1] || page_id || CASE WHEN page_id%5=0 THEN '/' ELSE '' END AS link FROM pages)"
PLATFORM = "CASE " + " ".join(f"WHEN regexp_matches(lower(link), '{p}') THEN '{n}'" for n, p in U.PLATFORM_PATTERNS.items()) + " ELSE 'other' END"
PLAT = f"pl AS (SELECT *, {PLATFORM} AS platform FROM links)"
SPAMMY = "sp AS (SELECT id, [" + ",".join(f"'{x}'" for x in SPAM_FORMS) + f"][id%{len(SPAM_FORMS)}+1] || text AS text, like_count FROM comments)"
QUOTED = """qt AS (SELECT conv_id*100+turn AS id, text || ' At ' || turn || ' minutes, ' || (conv_id%60) || ':' || lpad(CAST(turn*7%60 AS VARCHAR),2,'0')
   || ' then 1:' || lpad(CAST(turn*7%60 AS VARCHAR),2,'0') || ':45 and ' || (turn*3) || ' seconds, 1,234.5' AS text FROM conversations)"""
SPANS = """spn AS (SELECT id, CASE id%4 WHEN 0 THEN repeat(substr(text,1,12),5) || ' ' || text WHEN 1 THEN text || ' ' || repeat('yes ',9) || 'no' WHEN 2 THEN 'Um like ' || text ELSE text END AS t,
   start_time, CASE WHEN id%9=0 THEN start_time-1 ELSE end_time END AS end_time FROM segments)"""


def handle_sql():
    parts = []
    for name, (prefix, patterns, reserved) in U.HANDLE_RULES.items():
        for p in patterns:
            h = f"nullif(regexp_extract(link, '{p}', 1), '')"
            extra = f" AND {h} NOT IN {in_list(reserved)}" if reserved else ""
            parts.append(f"CASE WHEN platform='{name}'{extra} THEN '{prefix}' || {h} END")
    return "coalesce(" + ", ".join(parts) + ", platform || ':' || nullif(regexp_extract(rtrim(link,'/'), '([^/]*)$', 1), ''))"


def canonical_sql():
    u = "CASE WHEN page_id%4=0 THEN '' ELSE link END"
    rest = " ".join(f"WHEN platform='{n}' THEN CASE WHEN {u}<>'' THEN {u} ELSE '{stem}' || page_id END" for n, stem in U.DEFAULT_URLS.items())
    return f"""CASE WHEN platform='youtube' THEN CASE WHEN contains({u},'shorts') THEN 'https://www.youtube.com/shorts/' ELSE 'https://www.youtube.com/watch?v=' END || page_id
      {rest} ELSE {u} END"""


TC = "CAST(floor(page_id*37.7::DOUBLE) AS BIGINT)"
MARK = "CASE WHEN contains(link,'?') THEN '&t=' ELSE '?t=' END"
# ten or more characters written four times in a row: three multiples of the period begin with the same ten characters
LOOPS = """cs AS MATERIALIZED (SELECT id, length(t) AS n, t FROM {0} WHERE length(t)>=40),
  gr AS MATERIALIZED (SELECT id, i, hash(substr(t,i+1,10)) AS g FROM (SELECT id, t, unnest(range(0, n-9)) AS i FROM cs)),
  pj AS MATERIALIZED (SELECT id, p, unnest(range(0, ((n-10)//p-1)*p, p)) AS i FROM (SELECT id, n, unnest(range(10, n//4+1)) AS p FROM cs)),
  pa AS MATERIALIZED (SELECT pj.id, p, pj.i, g FROM pj JOIN gr ON gr.id=pj.id AND gr.i=pj.i),
  pb AS MATERIALIZED (SELECT pa.id, p, pa.i, pa.g FROM pa JOIN gr ON gr.id=pa.id AND gr.i=pa.i+p AND gr.g=pa.g),
  ab AS MATERIALIZED (SELECT pb.id, p, pb.i FROM pb JOIN gr ON gr.id=pb.id AND gr.i=pb.i+2*p AND gr.g=pb.g),
  ac AS MATERIALIZED (SELECT ab.id, p, i FROM ab JOIN {0} USING (id) WHERE substr(t,i+1,2*p)=substr(t,i+1+p,2*p)),
  ez AS MATERIALIZED (SELECT DISTINCT id FROM ac JOIN {0} USING (id)
    WHERE i+4*p<=length(t) AND substr(t,i+1,3*p)=substr(t,i+1+p,3*p) AND NOT contains(substr(t,i+1,4*p), chr(10)) AND NOT contains(substr(t,i+1,4*p), chr(13))),
  lo AS (SELECT id FROM ez UNION SELECT DISTINCT id FROM (SELECT id, p, unnest(range(greatest(0, i-p+1), i+1)) AS s FROM ac WHERE id NOT IN (SELECT id FROM ez)) JOIN {0} USING (id)
    WHERE s+4*p<=length(t) AND substr(t,s+1,3*p)=substr(t,s+1+p,3*p) AND NOT contains(substr(t,s+1,4*p), chr(10)) AND NOT contains(substr(t,s+1,4*p), chr(13)))"""
LOOPED = "(" + " OR ".join([
    "id IN (SELECT id FROM lo)",
    r"regexp_matches(t,'(?i)(thank you\.?\s*){4,}')", r"regexp_matches(t,'(?i)(please subscribe\.?\s*){3,}')",
    r"regexp_matches(t,'(?i)(music\.?\s*){5,}')", r"regexp_matches(t,'(\.\.\.){5,}')"]) + ")"


def bands(i):
    out = f"'{CONFIDENCE_BANDS[0][i]}'"
    for row in CONFIDENCE_BANDS[1:]:
        out = f"CASE WHEN p>={row[0]} THEN '{row[i]}' ELSE {out} END"
    return out


from .catalog_comments import MARKS, SPAM_SQL, STAMP_LIST, STAMPS, TOX_SQL  # noqa: E402

H, M, SEC = [f"list_transform(regexp_extract_all(text,'{p}'), lambda x: {e})" for p, e in (
    (STAMPS[0], "CAST(string_split(x,':')[1] AS BIGINT)*3600+CAST(string_split(x,':')[2] AS BIGINT)*60+CAST(string_split(x,':')[3] AS BIGINT)"),
    (STAMPS[1], "CAST(string_split(x,':')[1] AS BIGINT)*60+CAST(string_split(x,':')[2] AS BIGINT)"),
    (STAMPS[2], "CAST(regexp_extract(x,'(\\d+)',1) AS BIGINT)"))]
SEC4 = f"list_transform(regexp_extract_all(text,'{STAMPS[3]}'), lambda x: CAST(regexp_extract(x,'(\\d+)',1) AS BIGINT))"

ORACLE = {
    "detect_platform": f"WITH {LINKS}, {PLAT} SELECT page_id, platform FROM pl",
    "channel_key": f"WITH {LINKS}, {PLAT} SELECT page_id, {handle_sql()} AS channel_key FROM pl",
    "canonical_url": f"WITH {LINKS}, {PLAT} SELECT page_id, {canonical_sql()} AS url FROM pl",
    "timecoded_url": f"""WITH {LINKS} SELECT page_id, CASE WHEN regexp_matches(lower(link),'youtube\\.com|youtu\\.be') THEN link || {MARK} || {TC} || 's'
        WHEN contains(lower(link),'twitch.tv') THEN link || {MARK} || CASE WHEN {TC}>=3600 THEN ({TC}//3600) || 'h' ELSE '' END || ({TC}%3600//60) || 'm' || ({TC}%60) || 's'
        WHEN contains(lower(link),'vimeo.com') THEN link || '#t=' || {TC} || 's' ELSE link END AS url FROM links""",
    "url_job_type": f"""WITH {LINKS} SELECT page_id, CASE WHEN regexp_matches(lower(link),'playlist|list=') THEN 'playlist'
        WHEN regexp_matches(lower(link),'/@|/c/|/channel/|/user/') THEN 'channel' ELSE 'video' END AS job FROM links""",
    "comment_key": sql("comments", """SELECT id, CASE WHEN id%2=0 THEN 'youtube:' || id ELSE 'youtube:h' ||
        substr(sha256('youtube:' || author_id || ':' || substr(text,1,100) || ':' || like_count),1,16) END AS key FROM comments"""),
    "parse_posted": sql("comments", """SELECT id, CASE id%3 WHEN 0 THEN make_timestamp((id+1704067200)*1000000) WHEN 1 THEN timestamp_posted END AS posted FROM comments"""),
    "extract_timestamps": f"""WITH {QUOTED} SELECT id, array_to_string({STAMP_LIST},'|') AS raw,
        array_to_string(list_concat(list_concat({H},{M}),list_concat({SEC},{SEC4})),'|') AS seconds FROM qt""",
    "extract_numbers": f"WITH {QUOTED} SELECT id, array_to_string(regexp_extract_all(text,'\\b\\d[\\d,.:]*\\d|\\b\\d+\\b'),'|') AS numbers FROM qt",
    "quick_spam": sql("comments", f"""SELECT id, {r('''(CASE WHEN contains(lower(text),'subscribe') OR contains(lower(text),'check out my') OR contains(lower(text),'promo code')
        OR contains(lower(text),'free gift') THEN 0.4 ELSE 0 END+CASE WHEN (length(text)-length(replace(lower(text),'http','')))//4>=2 THEN 0.3 ELSE 0 END
        +CASE WHEN length(text)<5 THEN 0.2 ELSE 0 END)*CASE WHEN like_count>=100 THEN 0.15 WHEN like_count>=10 THEN 0.5 ELSE 1 END''', 4)} AS score FROM sp""", SPAMMY),
    "spam_score": sql("comments", f"SELECT id, {r(SPAM_SQL, 4)} AS score FROM sp", SPAMMY),
    "toxicity_score": sql("comments", f"SELECT id, {r(TOX_SQL, 4)} AS score FROM sp", SPAMMY),
    "comment_status": sql("comments", "SELECT id, CASE WHEN like_count/150>=0.75 THEN 'spam' WHEN toxicity_score>=0.8 THEN 'toxic' ELSE 'processed' END AS status FROM comments"),
    "sentiment_signed": sql("comments", """SELECT id, CASE sentiment_label WHEN 'positive' THEN abs(sentiment_score) WHEN 'negative' THEN -abs(sentiment_score) ELSE 0.0::DOUBLE END AS score,
        CASE WHEN sentiment_label IN ('positive','negative') THEN sentiment_label ELSE 'neutral' END AS label FROM comments"""),
    "entity_type_map": sql("comments", """SELECT id, ['person','organization','location','location','product','event','concept','location','organization','concept','concept'][id%11+1] AS kind FROM comments"""),
    "clean_filler": sql("segments", f"SELECT id, array_to_string(list_filter({raw_words('t')}, lambda w: lower(w) NOT IN {in_list(ASR_FILLERS)}),' ') AS t FROM spn", SPANS),
    "is_hallucination": sql("segments", f"""SELECT id, t='' OR rep OR (n>5 AND top/n>0.6) OR end_time<start_time AS bad FROM (SELECT id, start_time, end_time, t,
        {LOOPED} AS rep, len(w) AS n, coalesce(list_max(list_transform(list_distinct(w), lambda a: len(list_filter(w, lambda b: b=a)))),0) AS top FROM (SELECT *, {words('t')} AS w FROM tx))""",
        SPANS, "tx AS (SELECT id, start_time, end_time, trim(t) AS t FROM spn)", LOOPS.format("tx")),
    "crawl_priority": sql("videos channels", f"""SELECT v.id, {r('''greatest(0, log10(greatest(view_count,1)) + greatest(0, 100-date_diff('day', CAST(uploaded_at AS DATE), DATE '2001-08-02'))*0.5
        - CASE WHEN duration_seconds<>0 AND (duration_seconds<5 OR duration_seconds>14400) THEN 20 WHEN duration_seconds>3600 THEN 5 ELSE 0 END
        + ''' + '+'.join(f"CASE WHEN contains(lower(title || CASE WHEN v.id%2=0 THEN ' Tutorial: how to REVIEW' ELSE '' END), '{k}') THEN {b} ELSE 0 END" for k, b in PRIORITY_RULES['keyword_boosts'].items())
        + ' + log10(greatest(v.like_count,1))*0.5 + CASE priority_tier WHEN 1 THEN 1.0 WHEN 2 THEN 1.5 WHEN 3 THEN 2.0 WHEN 4 THEN 3.0 ELSE 5.0 END*5)', 2)} AS priority
        FROM videos v JOIN channels c ON c.id=v.channel_id"""),
    "confidence_band": sql("audio_windows", f"SELECT id, {r('p', 4)} AS probability, {bands(1)} AS band, {bands(2)} AS label, {bands(3)} AS colour FROM (SELECT id, {clip('music_probability*1.3-0.1')} AS p FROM audio_windows)"),
    "band_from_value": sql("audio_windows", f"""SELECT id, {r(clip('harmonic_ratio'), 4)} AS value, {r(clip('harmonic_ratio-0.2'), 4)} AS lower,
        {r(clip('harmonic_ratio+0.2'), 4)} AS upper, 'heuristic' AS method FROM audio_windows"""),
    "overall_manipulation": sql("audio_windows", f"""SELECT id, {r('music_probability*0.2+speech_probability*0.2+harmonic_ratio*0.15+zero_crossing_rate*0.15+overall_manipulation*0.15+dynamic_range_db/20*0.15', 6)} AS score FROM audio_windows"""),
    "lufs_levels": sql("audio_windows", f"""SELECT id, {r('pow(10, loudness_lufs/20)+1e-8', 6)} AS linear, {r(f"coalesce({clip('(loudness_lufs+60)/60')}, speech_probability)", 6)} AS energy FROM audio_windows"""),
    "uploaded_at": sql("videos", "SELECT id, CASE WHEN id%5<>0 THEN CAST(CAST(uploaded_at AS DATE) AS TIMESTAMP) END AS uploaded FROM videos"),
    "vector_hash": sql("vectors", "SELECT id, substr(sha256(array_to_string(list_transform(vector, lambda x: CAST(floor(x*1000) AS BIGINT)), ',')),1,16) AS hash FROM vectors"),
    "node_id_label": sql("videos", """SELECT id, CASE WHEN id%3=0 THEN title ELSE CAST(id AS VARCHAR) END AS node_id,
        CASE id%4 WHEN 0 THEN substr(repeat(title,6),1,50) WHEN 1 THEN platform ELSE 'Video' END AS label FROM videos"""),
    "hours_since": sql("videos", "SELECT id, CASE WHEN id%5=0 THEN -1 ELSE CAST(floor((epoch(TIMESTAMP '2001-08-02')-epoch(uploaded_at))/3600) AS BIGINT) END AS hours FROM videos"),
    "l2_normalize": sql("vectors", f"""SELECT id, {r('vector[1]::DOUBLE/n', 6)} AS v0, 1.0::DOUBLE AS norm FROM (SELECT *, sqrt(list_sum(list_transform(vector, lambda x: x::DOUBLE*x::DOUBLE))) AS n FROM vectors)"""),
}
