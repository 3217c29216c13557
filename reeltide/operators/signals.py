"""Signals over videos, channels and audiences."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.numbers import rnd, whole_number_seconds
from ..functions.scores import cosine
from ..functions.urls import domain
from ..session import cut_lineage
from .comments import with_parent
from .ordered import time_bucket, with_island, with_neighbours, with_next, with_position, with_previous

DAY, MONTH = 86400.0, 30 * 86400.0
URL = r"""https?://[^\s)"'<>]+"""


def cursor_heatmap(points: DataFrame, window: float = 30.0, columns: int = 16, rows: int = 10):
    """points: video_id, id, t, x, y, is_click with x and y in [0, 1). (grid cells, window summary)."""
    p = points.withColumn("win", time_bucket("t", window))
    keys = ["video_id", "win"]
    p = with_next(p, keys, ["t", "id"], time_bucket("t", window), ["t", "x", "y"])
    dwell = F.coalesce(F.col("next.t") - F.col("t"), F.lit(0.0))
    step = F.coalesce(F.sqrt(F.pow(F.col("next.x") - F.col("x"), 2) + F.pow(F.col("next.y") - F.col("y"), 2)), F.lit(0.0))
    p = p.withColumns({"dwell": dwell, "step": step, "cx": F.floor(F.col("x") * columns), "cy": F.floor(F.col("y") * rows)})
    cells = p.groupBy(*keys, "cx", "cy").agg(rnd(F.sum("dwell"), 3).alias("dwell_s"), F.count_if("is_click").alias("clicks"))
    d = F.sum("dwell")
    idle = F.sum(F.when(F.col("step") < 2 / 1000, F.col("dwell")).otherwise(0.0))
    summary = p.groupBy(*keys).agg(
        rnd(F.when(d > 0, F.sum(F.col("x") * F.col("dwell")) / d), 4).alias("hotspot_x"), rnd(F.when(d > 0, F.sum(F.col("y") * F.col("dwell")) / d), 4).alias("hotspot_y"),
        rnd(F.sum("step"), 4).alias("distance"), rnd(F.sum("step") / window, 4).alias("velocity"), rnd(F.when(d > 0, idle / d), 4).alias("idle_ratio"))
    return cells, summary


def text_edit_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("video_id", "action").agg(
        F.count(F.lit(1)).alias("edits"), F.sum("keystrokes").alias("keystrokes"), rnd(F.avg("time_to_correction_ms"), 2).alias("mean_correction_ms"),
        F.count_if("is_syntax_fix").alias("syntax_fixes"), F.count_if("is_logic_fix").alias("logic_fixes"))


def face_ratio(frames: DataFrame, window: float = 30.0) -> DataFrame:
    return frames.groupBy("video_id", time_bucket("timestamp", window).alias("win")).agg(
        rnd(F.count_if(F.col("face_count") > 0) / F.count(F.lit(1)), 4).alias("face_ratio"), F.max("face_count").alias("max_faces"), rnd(F.avg("face_area"), 4).alias("mean_area"))


def background_changes(video_vectors: DataFrame, threshold: float = 0.6) -> DataFrame:
    v = video_vectors.withColumn("at", whole_number_seconds("uploaded_at"))
    v = with_previous(v, "channel_id", ["at", "id"], time_bucket("at", MONTH), ["id", "vector"]).filter("prev is not null")
    v = v.withColumn("c", rnd(cosine(F.col("vector"), F.col("prev.vector")), 4))
    return v.filter(F.col("c") < threshold).select("channel_id", F.col("prev.id").alias("from_video"), F.col("id").alias("to_video"), F.col("c").alias("similarity"), rnd(1 - F.col("c"), 4).alias("distance"))


def upload_patterns(uploads: DataFrame, limit: float = 2.0) -> DataFrame:
    u = uploads.withColumns({"at": whole_number_seconds("ts"), "us": F.unix_micros("ts"), "hour": F.hour("ts").cast("long"), "weekday": F.weekday("ts").cast("long")})
    u = with_previous(u, "channel_id", ["at", "video_id"], time_bucket("at", MONTH), ["us"])
    # mean and deviation from whole sums: a hour exactly at the limit must not pass it by the error of a running mean
    exact = [F.col(c).cast("decimal(38,0)") for c in ("n", "s", "q")]
    s = u.groupBy("channel_id").agg(F.count("hour").alias("n"), F.sum("hour").alias("s"), F.sum(F.col("hour") * F.col("hour")).alias("q"))
    s = s.select("channel_id", "n", "s", F.sqrt((exact[0] * exact[2] - exact[1] * exact[1]).cast("double")).alias("spread"))
    j = u.join(s, "channel_id")
    z = F.when(F.col("spread") > 0, (F.col("hour") * F.col("n") - F.col("s")) / F.col("spread"))
    return j.select("channel_id", "video_id", "hour", "weekday", F.floor((F.col("us") - F.col("prev.us")) / (DAY * 1e6)).cast("long").alias("days_since_last"),
                    rnd(z, 4).alias("hour_z"), F.coalesce(F.abs(z) > limit, F.lit(False)).alias("is_anomalous"))


def title_edits(snapshots: DataFrame, fields: list[str]) -> DataFrame:
    """snapshots: video_id, snapshot_ts, uploaded_at and the fields, one row per crawl."""
    s = snapshots.withColumn("at", whole_number_seconds("snapshot_ts"))
    s = with_previous(s, "video_id", ["at"], time_bucket("at", MONTH), fields).filter("prev is not null")
    changes = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"prev.{f}")), F.struct(
        F.lit(f).alias("field"), F.col(f"prev.{f}").cast("string").alias("old_value"), F.col(f).cast("string").alias("new_value"))) for f in fields]))
    hours = rnd((F.col("at") - whole_number_seconds("uploaded_at")) / 3600.0, 1)
    return s.select("video_id", "snapshot_ts", hours.alias("hours_after_upload"), F.explode(changes).alias("c")).select("video_id", "snapshot_ts", "hours_after_upload", "c.*")


def palette_drift(thumbs: DataFrame) -> DataFrame:
    dims = ["brightness", "saturation", "contrast"]
    mean = thumbs.groupBy("channel_id").agg(*[F.avg(c).alias(f"m_{c}") for c in dims])
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"m_{c}"), 2) for c in dims), F.lit(0.0)))
    return thumbs.join(mean, "channel_id").select("channel_id", "video_id", rnd(d, 4).alias("drift"))


def description_links(descriptions: DataFrame) -> DataFrame:
    """(video_id, url, domain, is_affiliate, is_self) of every link; descriptions: video_id, text, own_url."""
    x = descriptions.select("video_id", "own_url", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(URL), F.lit(0)))).alias("url"))
    d = domain("url")
    return x.withColumn("domain", d).select(
        "video_id", "url", "domain", (F.col("domain").isin(L.AFFILIATE_DOMAINS) | F.col("url").rlike(r"[?&](tag|ref)=")).alias("is_affiliate"),
        F.coalesce(F.contains("url", F.nullif("own_url", F.lit(""))), F.lit(False)).alias("is_self"))


def link_checks(links: DataFrame, checks: DataFrame) -> DataFrame:
    """Latest state of each link and when it died for good; checks: url, checked_at, status."""
    ok = F.col("status").between(200, 399)
    last = checks.groupBy("url").agg(F.max(F.when(ok, F.col("checked_at"))).alias("last_ok"), F.max_by(ok, "checked_at").alias("alive"))
    dead = checks.join(last, "url").filter(~ok & (F.col("last_ok").isNull() | (F.col("checked_at") > F.col("last_ok")))).groupBy("url").agg(F.min("checked_at").alias("first_dead"))
    return links.join(last.select("url", "alive"), "url", "left").join(dead, "url", "left")


def link_health(checked: DataFrame, by: str = "video_id") -> DataFrame:
    dead = F.count_if(~F.coalesce("alive", F.lit(True)))
    return checked.groupBy(by).agg(F.count(F.lit(1)).alias("links"), dead.alias("dead"), rnd(dead / F.count(F.lit(1)), 4).alias("rot_rate"),
                                   F.count_if("is_affiliate").alias("affiliate"), F.count_if("is_self").alias("self_links"))


def pinned_history(snapshots: DataFrame) -> DataFrame:
    """Runs of one pinned comment; snapshots: video_id, snapshot_ts, pinned_id."""
    s = snapshots.withColumn("at", whole_number_seconds("snapshot_ts"))
    b = time_bucket("at", MONTH)
    s = with_neighbours(s, "video_id", ["at"], b, ["pinned_id", "snapshot_ts"])
    s = with_island(s, "video_id", ["at"], b, F.col("prev").isNull() | ~F.col("prev.pinned_id").eqNullSafe(F.col("pinned_id")))
    return s.filter("pinned_id is not null").groupBy("video_id", "island").agg(
        F.first("pinned_id").alias("pinned_id"), F.min("snapshot_ts").alias("detected_at"), F.max_by("next.snapshot_ts", "at").alias("unpinned_at")).drop("island")


def sentiment_drift(comments: DataFrame, videos: DataFrame) -> DataFrame:
    """Mood in growing windows after the upload; each comment is counted in every window it falls into."""
    # --- fixed: windows in hours
    windows = {"hour_1": 1, "day_1": 24, "day_7": 168, "day_30": 720, "day_90": 2160}
    age = (whole_number_seconds("timestamp_posted") - whole_number_seconds("uploaded_at")) / 3600.0
    j = comments.join(videos.select(F.col("id").alias("video_id"), "uploaded_at"), "video_id").withColumn("age", age).filter("age >= 0")
    hit = F.array_compact(F.array(*[F.when(F.col("age") <= h, F.lit(w)) for w, h in windows.items()]))
    j = j.select("video_id", "sentiment_score", "toxicity_score", F.explode(hit).alias("time_window"))
    n, s = F.count(F.lit(1)), F.coalesce("sentiment_score", F.lit(0.0))
    return j.groupBy("video_id", "time_window").agg(
        n.alias("comment_count"), rnd(F.avg(s), 4).alias("avg_sentiment"), rnd(F.count_if(s > 0.2) / n, 4).alias("positive_ratio"), rnd(F.count_if(s < -0.2) / n, 4).alias("negative_ratio"),
        rnd(F.coalesce(F.avg("toxicity_score"), F.lit(0.0)), 4).alias("toxicity"))


def deleted_shadows(comments: DataFrame, previous: DataFrame) -> DataFrame:
    """Parents that replies still name but that are gone, with what the last crawl knew of them."""
    refs = comments.filter("parent_comment_id is not null").groupBy(F.col("parent_comment_id").alias("id")).agg(F.count(F.lit(1)).alias("orphaned_replies"))
    return refs.join(comments.select("id"), "id", "left_anti").join(
        previous.select("id", F.col("text").alias("last_text"), F.col("author_id").alias("last_author")), "id", "left")


def reuse(prints: DataFrame, step: float = 1.0, min_seconds: float = 2.0, stock_channels: int = 3) -> DataFrame:
    """Stretches that two videos share; prints: video_id, channel_id, timestamp (on the step grid), hash.

    A stretch of two or more blocks contains two neighbouring blocks, so videos are matched on pairs of neighbouring
    hashes: single blocks that many videos share bring no candidates.
    """
    p = prints.select("video_id", "channel_id", F.floor(F.col("timestamp") / step).cast("long").alias("k"), "hash")
    # more than one video: the smallest is not the largest
    ends = [F.min("v0").alias("v0"), F.max("v1").alias("v1")]
    spread = p.groupBy("hash", "channel_id").agg(F.min("video_id").alias("v0"), F.max("video_id").alias("v1")).groupBy("hash").agg(*ends, F.count("channel_id").alias("channels")).filter("v0 < v1")
    p = p.join(spread.select("hash", (F.col("channels") >= stock_channels).alias("stock")), "hash").select("video_id", "k", "hash", "stock").distinct()
    blocks = 1
    if min_seconds > step:
        follow = p.select("video_id", (F.col("k") - 1).alias("k"), F.col("hash").alias("hash2"), F.col("stock").alias("stock2"))
        p = p.join(follow, ["video_id", "k"]).select("video_id", "k", F.struct("hash", "hash2").alias("hash"), (F.col("stock") | F.col("stock2")).alias("stock"))
        shared = p.groupBy("hash").agg(F.min("video_id").alias("v0"), F.max("video_id").alias("v1")).filter("v0 < v1").select("hash")
        p = p.join(shared, "hash", "left_semi")
        blocks = 2
    a = p.select("hash", F.col("video_id").alias("a"), F.col("k").alias("ka"), "stock")
    b = p.select("hash", F.col("video_id").alias("b"), F.col("k").alias("kb"))
    keys = ["a", "b", "offset"]
    m = a.join(b, "hash").filter("a < b").groupBy("a", "b", "ka", (F.col("kb") - F.col("ka")).alias("offset")).agg(F.max("stock").alias("stock"))
    bucket = time_bucket("ka", 600)
    m = with_previous(cut_lineage(m), keys, ["ka"], bucket, ["ka"])
    m = with_island(m, keys, ["ka"], bucket, F.col("prev").isNull() | (F.col("ka") - F.col("prev.ka") > 1))
    g = m.groupBy(*keys, "island").agg(F.min("ka").alias("k0"), F.max("ka").alias("k1"), F.max("stock").alias("is_stock"))
    dur = (F.col("k1") - F.col("k0") + blocks) * step
    return g.filter(dur >= min_seconds).select("a", "b", (F.col("k0") * step).alias("start_a"), ((F.col("k0") + F.col("offset")) * step).alias("start_b"), dur.alias("duration"), "is_stock")


def sponsor_segments(segments: DataFrame, durations: DataFrame, lexicon: dict | None = None, gap: float = 5.0) -> DataFrame:
    """Runs of segments that carry promotional phrases."""
    low = F.lower("text")
    kind = F.lit(None).cast("string")
    for name, phrases in reversed(list((lexicon or L.SPONSOR_LEXICON).items())):
        kind = F.when(T.phrase_hits(low, phrases) > 0, name).otherwise(kind)
    s = segments.select("video_id", "id", "start_time", "end_time", kind.alias("kind"))
    b = time_bucket("start_time", 600)
    # the position counts all segments, so that a run knows how many of its segments were hits
    s = with_position(s, "video_id", ["start_time", "id"], b).filter("kind is not null")
    s = with_previous(s, ["video_id", "kind"], ["start_time", "id"], b, ["end_time"])
    s = with_island(s, ["video_id", "kind"], ["start_time", "id"], b, F.col("prev").isNull() | (F.col("start_time") - F.col("prev.end_time") > gap))
    g = s.groupBy("video_id", "kind", "island").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count(F.lit(1)).alias("hits"), (F.max("pos") - F.min("pos") + 1).alias("span"))
    return g.join(durations, "video_id").select(
        "video_id", F.col("kind").alias("sponsor_type"), "start_time", "end_time", rnd(F.col("end_time") - F.col("start_time"), 3).alias("duration"),
        rnd(F.col("start_time") / F.greatest("duration_s", F.lit(1e-9)), 4).alias("position_ratio"), rnd(F.col("hits") / F.col("span"), 4).alias("confidence"))


def intro_outro(prints: DataFrame) -> DataFrame:
    """prints: channel_id, video_id, uploaded_at, first_hash, last_hash. Shared openings and endings, and when they were dropped."""
    out = prints.withColumn("at", whole_number_seconds("uploaded_at"))
    for c, name in (("first_hash", "has_intro"), ("last_hash", "has_outro")):
        shared = prints.groupBy("channel_id", c).agg((F.count_distinct("video_id") >= 2).alias(name))
        out = out.join(shared, ["channel_id", c], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    out = with_previous(out, "channel_id", ["at", "video_id"], time_bucket("at", MONTH), ["has_intro", "has_outro"])
    return out.select("channel_id", "video_id", "has_intro", "has_outro", F.coalesce(F.col("prev.has_intro") & ~F.col("has_intro"), F.lit(False)).alias("intro_dropped"),
                      F.coalesce(F.col("prev.has_outro") & ~F.col("has_outro"), F.lit(False)).alias("outro_dropped"))


def linguistic_profile(segments: DataFrame, common: int = 5000, fillers=None, hedges=None) -> DataFrame:
    """Language switching, word use and speed of each video."""
    said = segments.withColumn("w", T.words("text"))
    # words are counted before the rows are dealt, so no text travels with them
    s = said.select("video_id", "id", "start_time", "end_time", "language", F.size("w").alias("words"),
                    T.count_words_in(F.col("w"), fillers or L.STYLE_FILLERS).alias("fillers"), T.count_words_in(F.col("w"), hedges or L.STYLE_HEDGES).alias("hedges"))
    s = with_previous(s, "video_id", ["start_time", "id"], time_bucket("start_time", 600), ["language"])
    base = s.groupBy("video_id").agg(
        F.count_if(F.col("prev.language") != F.col("language")).alias("code_switches"), F.count_distinct("language").alias("languages"),
        F.sum("fillers").alias("filler_count"), F.sum("hedges").alias("hedge_count"), F.sum("words").alias("words"), F.max("end_time").alias("len"))
    counts = said.select("video_id", F.explode("w").alias("word")).groupBy("video_id", "word").agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy("word").agg(F.sum("c").alias("t")).orderBy(F.desc("t"), "word").limit(common).select("word", F.lit(1).alias("common"))
    # rank of a frequency = words above it + its place among equal ones; equal frequencies are handled as one block
    freq = counts.join(top, "word", "left").groupBy("video_id", "c").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("common").isNull()).alias("rare"))
    from pyspark.sql import Window
    above = Window.partitionBy("video_id").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    freq = freq.withColumn("r0", F.coalesce(F.sum("k").over(above), F.lit(0)))
    # one row per rank is spelled out with the block it belongs to, the first of them carries its sums
    ranks = freq.select("video_id", "c", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("i"), "r0", "k", "rare")
    first = F.col("i") == 1
    use = ranks.groupBy("video_id").agg(F.sum(F.when(first, F.col("k"))).alias("unique_words"), F.sum(F.when(first, F.col("rare"))).alias("rare_words"),
                                        F.regr_slope(F.log("c"), F.log(F.col("r0") + F.col("i"))).alias("slope"))
    # the null-safe key keeps a filter out of the counting, which both uses of the counts share; a video without a number has no words of its own
    use = use.withColumnRenamed("video_id", "of").withColumn("known", F.col("of").isNotNull())
    j = base.join(use, F.col("video_id").eqNullSafe(F.col("of")), "left")
    j = j.withColumns({x: F.when(F.col("known"), F.col(x)) for x in ("unique_words", "rare_words", "slope")}).fillna(0, ["unique_words", "rare_words"])
    return j.select(
        "video_id", "code_switches", "languages", "filler_count", "hedge_count", "unique_words", rnd(F.col("unique_words") / F.greatest("words", F.lit(1)), 4).alias("type_token_ratio"),
        "rare_words", rnd(F.col("slope") + 1, 3).alias("zipf_deviation"), rnd(F.col("words") / F.greatest(F.col("len") / 60, F.lit(1.0)), 2).alias("wpm"))


def language_shares(segments: DataFrame) -> DataFrame:
    n = segments.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    return segments.groupBy("video_id", "language").agg(F.count(F.lit(1)).alias("c")).join(n, "video_id").select("video_id", "language", rnd(F.col("c") / F.col("n"), 4).alias("share"))


def commenter_migration(comments: DataFrame) -> DataFrame:
    """Authors who moved from one channel to another; channels of one author are few next to their comments.

    The pairing runs over one row per author and channel. Comments on both channels at or after the first visit to
    the new one are then counted by a join on the found pairs only.
    """
    span = comments.groupBy("author_id", "channel_id").agg(F.min("timestamp_posted").alias("f"), F.max("timestamp_posted").alias("l"))
    a, b = [span.select("author_id", *[F.col(c).alias(f"{c}_{x}") for c in ("channel_id", "f", "l")]) for x in "ab"]
    p = a.join(b, "author_id").filter("f_a < f_b and l_a < l_b")
    hit = comments.select("author_id", F.col("channel_id").alias("ch"), F.col("timestamp_posted").alias("t"))
    both = p.select("author_id", "channel_id_a", "channel_id_b", "f_b", F.explode(F.array("channel_id_a", "channel_id_b")).alias("ch"))
    n = both.join(hit, ["author_id", "ch"]).filter("t >= f_b").groupBy("author_id", "channel_id_a", "channel_id_b").agg(
        F.count_if(F.col("ch") == F.col("channel_id_b")).alias("on_b"), F.count(F.lit(1)).alias("n"))
    days = F.greatest(F.lit(0), F.floor((whole_number_seconds("l_a") - whole_number_seconds("f_b")) / DAY)).cast("long")
    return p.join(n, ["author_id", "channel_id_a", "channel_id_b"]).select(
        "author_id", F.col("channel_id_a").alias("from_channel"), F.col("channel_id_b").alias("to_channel"), days.alias("overlap_days"), rnd(F.col("on_b") / F.col("n"), 3).alias("confidence"))


def entity_propagation(mentions: DataFrame) -> DataFrame:
    """(entity_id, origin, channel, lag) chain: later channels after the first, one row each."""
    first = mentions.groupBy("entity_id", "channel_id").agg(F.min("ts").alias("f"))
    origin = first.groupBy("entity_id").agg(F.min(F.struct("f", "channel_id")).alias("o"))
    return first.join(origin, "entity_id").filter("channel_id <> o.channel_id").select(
        "entity_id", F.col("o.channel_id").alias("origin_channel"), "channel_id", ((whole_number_seconds("f") - whole_number_seconds("o.f")) / 3600.0).alias("lag_hours"))


def propagation_summary(mentions: DataFrame) -> DataFrame:
    return entity_propagation(mentions).groupBy("entity_id", "origin_channel").agg(F.count(F.lit(1)).alias("adopters"), rnd(F.avg("lag_hours"), 1).alias("avg_lag_hours"))


def parasocial(comments: DataFrame, creators: DataFrame) -> DataFrame:
    """creators: channel_id, creator_id (the channel's own account)."""
    c = comments.join(creators, "channel_id")
    own = c.groupBy("author_id", "channel_id").agg(F.count(F.lit(1)).alias("comments"), F.first("creator_id").alias("creator_id"))
    answered = with_parent(comments, {"author_id": "to", "channel_id": "to_channel"}).join(creators.select(F.col("channel_id").alias("to_channel"), "creator_id"), "to_channel").filter(
        "author_id = creator_id").groupBy(F.col("to").alias("author_id"), F.col("to_channel").alias("channel_id")).agg(F.count(F.lit(1)).alias("creator_replies"))
    j = own.join(answered, ["author_id", "channel_id"], "left").fillna(0, ["creator_replies"]).filter("author_id <> creator_id")
    tier = F.when(F.col("comments") > 30, "superfan").when(F.col("comments") > 10, "regular").otherwise("casual")
    return j.select("author_id", "channel_id", "comments", "creator_replies", rnd(F.col("creator_replies") / F.col("comments"), 4).alias("reply_ratio"), tier.alias("tier"))


def topic_gestation(comment_mentions: DataFrame, video_mentions: DataFrame) -> DataFrame:
    """comment_mentions: channel_id, entity_id, ts, text; video_mentions: channel_id, entity_id, ts."""
    keys = ["channel_id", "entity_id"]
    asked = T.phrase_hits(F.lower("text"), L.REQUEST_PHRASES) > 0
    first = comment_mentions.groupBy(*keys).agg(F.min("ts").alias("f"))
    video = video_mentions.join(first, keys).filter(F.col("ts") > F.col("f")).groupBy(*keys).agg(F.first("f").alias("f"), F.min("ts").alias("v"))
    before = comment_mentions.join(video, keys).filter(F.col("ts") < F.col("v")).groupBy(*keys).agg(F.count(F.lit(1)).alias("mentions_before"), F.max(asked).alias("audience_requested"))
    return video.join(before, keys).select(*keys, F.col("f").alias("first_comment_at"), F.col("v").alias("first_video_at"),
                                           F.floor((whole_number_seconds("v") - whole_number_seconds("f")) / DAY).cast("long").alias("gestation_days"), "mentions_before", "audience_requested")


def room_clusters(prints: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """prints: channel_id, video_id, uploaded_at, vector. KMeans clusters and whether the room is that of the previous upload."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    p = prints.withColumn("features", array_to_vector(F.transform("vector", lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="room_cluster").fit(p)
    c = model.transform(p).drop("features").withColumn("at", whole_number_seconds("uploaded_at"))
    c = with_previous(c, "channel_id", ["at", "video_id"], time_bucket("at", MONTH), ["room_cluster"])
    return c.select("channel_id", "video_id", F.col("room_cluster").cast("long").alias("room_cluster"), F.coalesce(F.col("prev.room_cluster") == F.col("room_cluster"), F.lit(False)).alias("matches_previous"))
