"""Comment ingestion, thread trees and conversation measures."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import clip, rnd, std0
from .ordered import time_bucket, top_n_per_key, with_position
from .trees import ancestor_closure, resolve_chains

DAY = 86400.0


# ---- ingestion ---------------------------------------------------------------------------

def classify_incoming(raw: DataFrame, existing: DataFrame | None = None, spam_threshold: float = 0.75) -> DataFrame:
    """One row per comment key with its parent key and a verdict: ok, empty, spam or known."""
    key = "platform_comment_id"
    prefix = F.concat(F.col("platform"), F.lit(":"))
    parent = F.nullif(F.coalesce(F.col("parent_id"), F.lit("root")), F.lit(""))
    columns = [c for c in raw.columns if c != key]
    first = raw.groupBy(key).agg(F.min(F.struct("timestamp_posted", *[c for c in columns if c != "timestamp_posted"])).alias("r"))
    rows = first.select(key, "r.*").withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn(
        "parent_key",
        F.when(parent.isNull() | (parent == "root"), None).when(F.startswith(parent, prefix), parent).otherwise(F.concat(prefix, parent)))
    rows = rows.withColumn("spam", T.quick_spam("text", "like_count"))
    verdict = F.when(F.col("text") == "", "empty").when(F.col("spam") >= spam_threshold, "spam").otherwise("ok")
    rows = rows.withColumn("verdict", verdict)
    if existing is not None:
        seen = existing.select(key, F.lit(True).alias("_seen"))
        rows = rows.join(seen, key, "left").withColumn(
            "verdict", F.when(F.col("_seen"), "known").otherwise(F.col("verdict"))).drop("_seen")
    return rows


def build_threads(raw: DataFrame, existing: DataFrame | None = None, max_depth: int = 20, spam_threshold: float = 0.75) -> DataFrame:
    """New comments with parent, root and depth. ``existing``: (platform_comment_id, root_thread_id, depth_level)."""
    key = "platform_comment_id"
    rows = classify_incoming(raw, existing, spam_threshold).filter("verdict = 'ok'")
    known = None
    if existing is not None:
        known = existing.select(key, F.col("root_thread_id").alias("root"), F.col("depth_level").alias("depth"))
    placed = resolve_chains(rows, key, "parent_key", known, max_depth)
    return rows.join(placed, key).select(
        key, F.col("parent_key").alias("parent_comment_id"), F.col("root").alias("root_thread_id"),
        F.col("depth").alias("depth_level"), "platform", "video_id", "author_id", "text", "like_count", "timestamp_posted")


def ingest_stats(raw: DataFrame, threads: DataFrame, authors: DataFrame | None = None, existing: DataFrame | None = None,
                 spam_threshold: float = 0.75) -> DataFrame:
    verdicts = classify_incoming(raw, existing, spam_threshold)
    found = threads.select("platform", "author_id").distinct()
    if authors is not None:
        found = found.join(authors, ["platform", "author_id"], "left_anti")
    parts = [
        raw.agg(F.count(F.lit(1)).alias("v")).select(F.lit("fetched").alias("stat"), "v"),
        threads.agg(F.count(F.lit(1)).alias("v")).select(F.lit("new").alias("stat"), "v"),
        verdicts.agg(F.count_if(F.col("verdict") == "spam").alias("v")).select(F.lit("spam_filtered").alias("stat"), "v"),
        found.agg(F.count(F.lit(1)).alias("v")).select(F.lit("authors_discovered").alias("stat"), "v"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resolve_authors(threads: DataFrame, authors: DataFrame | None = None) -> DataFrame:
    """Author table after ingestion: counts and last sighting added to the stored rows."""
    fresh = threads.groupBy("platform", "author_id").agg(
        F.count(F.lit(1)).alias("comment_count"), F.min("timestamp_posted").alias("first_seen_at"),
        F.max("timestamp_posted").alias("last_seen_at"))
    if authors is None:
        return fresh
    return fresh.unionByName(authors.select(*fresh.columns)).groupBy("platform", "author_id").agg(
        F.sum("comment_count").alias("comment_count"), F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"))


# ---- trees -------------------------------------------------------------------------------

def full_threads(comments: DataFrame, comment_id=None) -> DataFrame:
    """Every comment of a thread with the thread's size and depth; one thread when ``comment_id`` is given."""
    if comment_id is not None:
        wanted = comments.filter(F.col("id") == comment_id).select("root_thread_id").limit(1)
        comments = comments.join(wanted, "root_thread_id", "left_semi")
    size = comments.groupBy("root_thread_id").agg(F.count(F.lit(1)).alias("total_comments"), F.max("depth_level").alias("max_depth"))
    out = comments.join(size, "root_thread_id").select(
        "root_thread_id", "id", "parent_comment_id", "author_id", "depth_level", "timestamp_posted", "total_comments", "max_depth")
    return out.orderBy("depth_level", "timestamp_posted", "id") if comment_id is not None else out


def descendants(comments: DataFrame, of: DataFrame, max_depth: int = 20) -> DataFrame:
    """Replies below each comment of ``of(id)`` with hop distance."""
    closure = ancestor_closure(comments, max_distance=max_depth)
    hit = closure.join(of.select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    return hit.join(comments.select(F.col("id").alias("descendant"), "author_id", "timestamp_posted"), "descendant").select(
        F.col("ancestor").alias("comment_id"), F.col("descendant").alias("reply_id"), "distance", "author_id", "timestamp_posted")


def parent_chain(comments: DataFrame, of: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """The comments above each comment with author and text, up to the root or ``max_depth`` hops."""
    closure = ancestor_closure(comments, max_distance=max_depth)
    if of is not None:
        closure = closure.join(of.select(F.col("id").alias("descendant")), "descendant", "left_semi")
    return closure.join(comments.select(F.col("id").alias("ancestor"), "author_id", "text"), "ancestor").select(
        F.col("descendant").alias("comment_id"), F.col("ancestor").alias("ancestor_id"), "distance", "author_id", "text")


def child_counts(comments: DataFrame) -> DataFrame:
    return comments.filter("parent_comment_id is not null").groupBy(F.col("parent_comment_id").alias("id")).agg(
        F.count(F.lit(1)).alias("child_count"))


def roots(comments: DataFrame) -> DataFrame:
    return comments.filter("parent_comment_id is null")


def leaves(comments: DataFrame) -> DataFrame:
    return comments.filter("parent_comment_id is not null").join(child_counts(comments), "id", "left_anti")


def most_branched(comments: DataFrame, n: int = 10) -> DataFrame:
    counted = comments.join(child_counts(comments), "id")
    return top_n_per_key(
        counted.select("video_id", "id", "text", "depth_level", "child_count"), "video_id", [F.desc("child_count"), F.asc("id")], n)


def longest_chains(comments: DataFrame, n: int = 10) -> DataFrame:
    chains = leaves(comments).select("id", "video_id").join(resolve_chains(comments, "id", "parent_comment_id"), "id")
    return top_n_per_key(
        chains.select("video_id", F.col("root").alias("root_id"), F.col("id").alias("leaf_id"), F.col("depth").alias("chain_length")),
        "video_id", [F.desc("chain_length"), F.asc("leaf_id")], n)


def debate_clusters(comments: DataFrame, min_depth: int = 3, min_replies: int = 3, n: int = 20) -> DataFrame:
    """Threads whose replies disagree, the n strongest per video; roots and depths come from the parent links."""
    placed = comments.join(resolve_chains(comments, "id", "parent_comment_id"), "id")
    replies = placed.filter("depth > 0").groupBy("video_id", F.col("root").alias("root_id")).agg(
        F.count(F.lit(1)).alias("reply_count"), F.avg("sentiment_score").alias("avg"),
        F.stddev_samp("sentiment_score").alias("sd"), F.max("depth").alias("max_depth"))
    kept = replies.filter((F.col("reply_count") >= min_replies) & (F.col("max_depth") >= min_depth)).select(
        "video_id", "root_id", "reply_count", rnd("avg", 2).alias("avg_sentiment"), rnd("sd", 2).alias("debate_score"), "max_depth")
    return top_n_per_key(kept, "video_id", [F.desc("debate_score"), F.asc("root_id")], n)


def thread_analysis(comments: DataFrame) -> DataFrame:
    reply = F.col("parent_comment_id").isNotNull()
    base = comments.groupBy("root_thread_id").agg(
        F.count(F.lit(1)).alias("total_comments"),
        F.count_distinct(F.when(reply, F.col("author_id"))).alias("unique_authors"),
        F.coalesce(rnd(F.avg(F.when(reply, F.coalesce("sentiment_score", F.lit(0.0)))), 3), F.lit(0.0)).alias("avg_sentiment"),
        F.max("depth_level").alias("max_depth"),
        F.coalesce(rnd(F.stddev_samp(F.when(reply, F.col("sentiment_score"))), 3), F.lit(0.0)).alias("debate_score"))
    branching = comments.join(child_counts(comments), "id").groupBy("root_thread_id").agg(
        F.max_by("depth_level", F.struct("child_count", -F.col("id"))).alias("most_branched_depth"))
    return base.join(branching, "root_thread_id", "left").withColumn("longest_chain_length", F.col("max_depth"))


# ---- who answers whom --------------------------------------------------------------------

def with_parent(comments: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Replies with columns of the answered comment."""
    parent = comments.select(F.col("id").alias("parent_comment_id"), *[F.col(c).alias(n) for c, n in fields.items()])
    return comments.filter("parent_comment_id is not null").join(parent, "parent_comment_id")


def replied_to(comments: DataFrame) -> DataFrame:
    """Counted author to author edges, answers to oneself left out."""
    return with_parent(comments, {"author_id": "target"}).filter("author_id <> target").groupBy(
        F.col("author_id").alias("source"), "target").agg(F.count(F.lit(1)).alias("count"))


def user_loops(edges: DataFrame, min_exchanges: int = 3, n: int = 50) -> DataFrame:
    """Pairs that answer each other, each once."""
    strong = edges.filter(F.col("count") >= min_exchanges)
    pair = strong.filter("source <> target").groupBy(
        F.least("source", "target").alias("user_a"), F.greatest("source", "target").alias("user_b")).agg(
        F.max(F.when(F.col("source") < F.col("target"), F.col("count"))).alias("a_to_b"),
        F.max(F.when(F.col("source") > F.col("target"), F.col("count"))).alias("b_to_a"))
    both = pair.filter("a_to_b is not null and b_to_a is not null").withColumn("total_exchanges", F.col("a_to_b") + F.col("b_to_a"))
    return both.orderBy(F.desc("total_exchanges"), "user_a", "user_b").limit(n)


def user_overlap(comments: DataFrame, author_id, min_shared: int = 2, n: int = 20) -> DataFrame:
    """Authors sharing videos with one author."""
    on = comments.select("author_id", "video_id").distinct()
    mine = on.filter(F.col("author_id") == author_id).select("video_id")
    shared = on.filter(F.col("author_id") != author_id).join(mine, "video_id", "left_semi").groupBy("author_id").agg(
        F.count(F.lit(1)).alias("shared_videos"))
    return shared.filter(F.col("shared_videos") >= min_shared).orderBy(F.desc("shared_videos"), "author_id").limit(n)


# ---- dynamics ----------------------------------------------------------------------------

def _score() -> Column:
    return F.coalesce(F.col("sentiment_score"), F.lit(0.0))


def top_topics(comments: DataFrame, key: str, n: int, name: str = "top_topics") -> DataFrame:
    counted = comments.select(key, F.explode("topic_labels").alias("topic")).groupBy(key, "topic").agg(F.count(F.lit(1)).alias("c"))
    best = top_n_per_key(counted, key, [F.desc("c"), F.asc("topic")], n)
    return best.groupBy(key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "topic"))), lambda x: x["topic"]).alias(name))


def debate_chains(comments: DataFrame) -> DataFrame:
    c = comments.withColumn("root", F.coalesce("root_thread_id", "id")).withColumn("s", _score())
    c = c.withColumn("at", F.unix_timestamp("timestamp_posted"))
    c = with_position(c, "root", ["at", "id"], time_bucket("at", DAY))
    mid = F.floor(F.col("n") / 2)
    first, second = F.col("pos") < mid, F.col("pos") >= mid
    by_time = F.struct("at", "id")
    g = c.groupBy("root").agg(
        F.first("n").alias("turn_count"), F.min("video_id").alias("video_id"), F.count_distinct("author_id").alias("participant_count"),
        (F.max("s") - F.min("s")).alias("spread"), F.stddev_pop(F.when(first, F.col("s"))).alias("sd1"),
        F.stddev_pop(F.when(second, F.col("s"))).alias("sd2"), F.max_by("s", by_time).alias("last"),
        F.max_by("depth_level", by_time).alias("last_depth"))
    half = F.floor(F.col("turn_count") / 2)
    sd1 = F.when(half > 2, F.col("sd1")).otherwise(0.0)
    sd2 = F.when(F.col("turn_count") - half > 2, F.col("sd2")).otherwise(0.0)
    g = g.filter((F.col("turn_count") >= 4) & (F.col("participant_count") >= 2) & (F.col("spread") >= 0.3))
    out = g.select(
        F.col("root").alias("root_comment_id"), "video_id", "participant_count", "turn_count",
        rnd("spread", 3).alias("sentiment_polarity_range"),
        rnd(clip((sd2 - sd1) / F.greatest(sd1, F.lit(0.01)), 0, 1), 3).alias("escalation_score"),
        F.when((F.col("turn_count") > 10) & (F.abs("last") < 0.1), "consensus")
        .when((F.col("turn_count") > 6) & (F.col("last_depth") == 0), "abandoned").otherwise("unresolved").alias("resolution"),
        rnd(F.least(F.lit(0.8), 0.3 + F.col("turn_count") * 0.02), 3).alias("confidence"))
    topics = top_topics(comments.withColumn("root_comment_id", F.coalesce("root_thread_id", "id")), "root_comment_id", 3, "key_topics")
    return out.join(topics, "root_comment_id", "left").withColumn("key_topics", F.coalesce("key_topics", F.array().cast("array<string>")))


def user_profiles(comments: DataFrame, topic_names: list[str]) -> DataFrame:
    c = comments.withColumn("s", _score()).withColumn("at", F.unix_timestamp("timestamp_posted"))
    days = F.greatest((F.max("at") - F.min("at")) / DAY, F.lit(1.0))
    n = F.count(F.lit(1))
    hours = F.array(*[F.count_if(F.hour("timestamp_posted") == h) for h in range(24)])
    g = c.groupBy("author_id").agg(
        n.alias("comment_count"), rnd(F.avg("s"), 3).alias("positivity_baseline"), rnd(std0("s"), 3).alias("positivity_std"),
        rnd(F.when(F.count("at") > 1, n / days).otherwise(0.0), 3).alias("engagement_velocity"),
        rnd(1.0 / F.greatest(F.count_distinct("channel_id"), F.lit(1)), 3).alias("cross_video_loyalty"),
        rnd(F.avg(F.length("text")), 1).alias("avg_comment_length"),
        rnd(F.count("parent_comment_id") / n, 3).alias("reply_ratio"), hours.alias("hour_counts"),
        rnd(F.least(F.lit(0.85), 0.2 + n * 0.01), 3).alias("confidence"))
    labels = comments.select("author_id", F.explode("topic_labels").alias("topic")).groupBy("author_id").agg(
        F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("topic") == t).alias(f"t{i}") for i, t in enumerate(topic_names)])
    vec = labels.select("author_id", F.array(*[rnd(F.col(f"t{i}") / F.col("all"), 4) for i in range(len(topic_names))]).alias("topic_vector"))
    return g.join(vec, "author_id", "left").join(top_topics(comments, "author_id", 5), "author_id", "left")


def community_metrics(comments: DataFrame, by: str = "video_id") -> DataFrame:
    c = comments.withColumn("s", _score())
    n = F.count(F.lit(1))
    base = c.groupBy(by).agg(
        n.alias("n"), F.count_if(F.col("s") > 0.2).alias("pos"), F.count_if(F.col("s") < -0.2).alias("neg"),
        F.coalesce(F.avg("toxicity_score"), F.lit(0.0)).alias("tox"), F.count_distinct("author_id").alias("unique_participant_count"),
        F.avg("depth_level").alias("depth"))
    w = T.words("text")
    tokens = c.select(by, w.alias("w")).filter(F.size("w") > 1)
    grams = tokens.select(by, F.explode(F.zip_with(
        F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).alias("gram"))
    memes = grams.groupBy(by, "gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 3").groupBy(by).agg(F.count(F.lit(1)).alias("memes"))
    topics = c.select(by, F.explode("topic_labels").alias("t")).groupBy(by).agg(F.count_distinct("t").alias("topics"))
    pairs = with_parent(c, {"author_id": "parent_author", by: "parent_by"}).filter(F.col(by) == F.col("parent_by"))
    pairs = pairs.groupBy(by).agg(F.count_distinct(F.struct(
        F.least("author_id", "parent_author"), F.greatest("author_id", "parent_author"))).alias("pairs"))
    j = base.join(memes, by, "left").join(topics, by, "left").join(pairs, by, "left").fillna(0, ["memes", "topics", "pairs"])
    divergence = F.least(F.lit(1.0), F.col("topics") / F.greatest(F.col("n") * 0.05, F.lit(1.0)))
    polar = F.when(F.col("n") > 10, F.least(F.lit(1.0), 2 * F.least("pos", "neg") / F.col("n"))).otherwise(0.0)
    return j.select(
        by, rnd(polar, 3).alias("polarization_index"),
        rnd(F.least(F.lit(1.0), F.col("memes") / F.greatest(F.col("n") * 0.1, F.lit(1.0))), 3).alias("meme_velocity"),
        rnd(divergence, 3).alias("narrative_divergence_score"), rnd(1 - divergence, 3).alias("topic_convergence_speed"),
        rnd("tox", 3).alias("toxicity_ratio"), rnd(1 - F.col("tox"), 3).alias("constructive_ratio"), "unique_participant_count",
        rnd("depth", 2).alias("avg_thread_depth"),
        rnd(F.least(F.lit(1.0), F.col("pairs") * 2 / F.greatest("unique_participant_count", F.lit(1))), 3).alias("reply_reciprocity"),
        rnd(F.least(F.lit(0.85), 0.2 + F.col("n") * 0.002), 3).alias("confidence"))


# ---- annotation --------------------------------------------------------------------------

def nlp_annotate(comments: DataFrame, spam_at: float = 0.75, toxic_at: float = 0.80) -> DataFrame:
    """Text scores, quoted times and numbers, and the status that follows. Model columns, if any, pass through."""
    stamps = T.extract_timestamps("text")
    out = comments.withColumn("_t", stamps).withColumn("spam_score", T.spam_score("text")).withColumn("toxicity_score", T.toxicity_score("text"))
    return out.withColumns({
        "extracted_timestamps": F.col("_t.raw"), "ts_seconds": F.col("_t.seconds"), "extracted_numbers": T.extract_numbers("text"),
        "status": T.comment_status("spam_score", "toxicity_score", spam_at, toxic_at)}).drop("_t")


def annotation_stats(annotated: DataFrame) -> DataFrame:
    return annotated.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("processed", "spam", "toxic")])


def entity_mentions(comments: DataFrame) -> DataFrame:
    """One row per recognised entity of a comment; needs ``entities array<struct<name,type>>``."""
    e = comments.select("id", "video_id", "timestamp_posted", "text", F.explode("entities").alias("e"))
    name = F.lower(F.trim("e.name"))
    return e.select(
        name.alias("canonical_name"), T.entity_type("e.type").alias("entity_type"), "video_id", F.lit("comment").alias("source_type"),
        F.col("id").alias("source_id"), F.substring("text", 1, 200).alias("context_text"), F.col("timestamp_posted").alias("ts"),
    ).filter(F.length("canonical_name") >= 2)


# ---- declared conversation measures ------------------------------------------------------

def echo_chambers(comments: DataFrame, min_threads: int = 2, max_gap: float = 0.2, min_size: int = 3) -> DataFrame:
    """Authors who meet often and feel alike, joined into clusters; insularity of their replies."""
    from .graph import communities
    from .pairs import overlap_pairs
    mood = comments.groupBy("author_id").agg(F.avg(_score()).alias("m"))
    pairs = overlap_pairs(comments, "author_id", "root_thread_id", min_threads)
    near = (pairs.join(mood.select(F.col("author_id").alias("a"), F.col("m").alias("ma")), "a")
            .join(mood.select(F.col("author_id").alias("b"), F.col("m").alias("mb")), "b")
            .filter(F.abs(F.col("ma") - F.col("mb")) <= max_gap + 1e-9))
    label = communities(near.select(F.col("a").alias("source"), F.col("b").alias("target")))
    size = label.groupBy("community_id").agg(F.count(F.lit(1)).alias("member_count")).filter(F.col("member_count") >= min_size)
    member = label.join(size, "community_id").select(F.col("id").alias("author_id"), "community_id", "member_count")
    replies = with_parent(comments, {"author_id": "target"}).select("author_id", "target").join(member, "author_id")
    other = member.select(F.col("author_id").alias("target"), F.col("community_id").alias("target_community"))
    inside = replies.join(other, "target", "left").groupBy("community_id").agg(
        F.count(F.lit(1)).alias("replies"), F.count_if(F.col("target_community") == F.col("community_id")).alias("inside"))
    return size.join(inside, "community_id", "left").select(
        "community_id", "member_count", F.coalesce("replies", F.lit(0)).alias("replies"),
        rnd(F.coalesce(F.col("inside") / F.col("replies"), F.lit(0.0)), 4).alias("insularity"))


def sentiment_cascades(comments: DataFrame, threshold: float = 0.2, min_size: int = 3) -> DataFrame:
    """Runs of same-signed comments in a thread."""
    from .ordered import with_island, with_previous
    c = comments.withColumn("at", F.unix_timestamp("timestamp_posted")).withColumn("s", _score())
    sign = F.when(F.col("s") > threshold, 1).when(F.col("s") < -threshold, -1).otherwise(0)
    c = c.select("root_thread_id", "id", "at", "s", sign.alias("sign"))
    b = time_bucket("at", DAY)
    c = with_previous(c, "root_thread_id", ["at", "id"], b, ["sign"])
    c = with_island(c, "root_thread_id", ["at", "id"], b, F.col("prev.sign").isNull() | (F.col("prev.sign") != F.col("sign")))
    order = F.struct("at", "id")
    runs = c.filter("sign <> 0").groupBy("root_thread_id", "island").agg(
        F.first("sign").alias("sign"), F.count(F.lit(1)).alias("cascade_size"), F.min("at").alias("t0"), F.max("at").alias("t1"),
        F.max(F.abs("s")).alias("peak"), F.abs(F.min_by("s", order)).alias("a"), F.abs(F.max_by("s", order)).alias("z"),
        F.min_by("id", order).alias("first_comment_id"))
    runs = runs.filter(F.col("cascade_size") >= min_size)
    both = runs.groupBy("root_thread_id").agg((F.count_distinct("sign") > 1).alias("controversy"))
    return runs.join(both, "root_thread_id").select(
        "root_thread_id", "first_comment_id", F.when(F.col("sign") > 0, "positive").otherwise("negative").alias("direction"),
        "cascade_size", rnd((F.col("t1") - F.col("t0")) / 60.0, 2).alias("minutes"), rnd("peak", 3).alias("peak_intensity"),
        rnd((F.col("a") - F.col("z")) / F.col("cascade_size"), 4).alias("damping"), "controversy")


def authority(comments: DataFrame) -> DataFrame:
    """How far replies to an author agree with them, per video."""
    r = with_parent(comments, {"author_id": "target", "video_id": "on_video"}).withColumn("s", _score())
    g = r.groupBy(F.col("on_video").alias("video_id"), F.col("target").alias("author_id")).agg(
        F.count_if(F.col("s") > 0.2).alias("acknowledged"), F.count_if(F.col("s") < -0.2).alias("challenged"))
    both = F.col("acknowledged") + F.col("challenged")
    return g.withColumn("authority_score", rnd(F.when(both > 0, F.col("acknowledged") / both), 4))
