"""Channel and video time series."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.numbers import clip, rnd, std0, whole_number_seconds
from ..functions.scores import energy
from ..session import cut_lineage
from .joins import DENSE, within
from .ordered import exact_quantile, time_bucket, with_position, with_previous, with_running

HOUR, DAY, WEEK = 3600.0, 86400.0, 604800.0
MONTH = 30 * DAY


def _stamped(uploads: DataFrame) -> DataFrame:
    return uploads.withColumn("at", whole_number_seconds("ts"))


# ---- channels ----------------------------------------------------------------------------

def upload_cadence(uploads: DataFrame) -> DataFrame:
    """Rhythm of each channel: interval statistics, weekday and hour counts, weekly periodicity."""
    u = _stamped(uploads)
    counts = u.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("upload_count"),
        F.array(*[F.count_if(F.weekday("ts") == d) for d in range(7)]).alias("weekday_counts"),
        F.array(*[F.count_if(F.hour("ts") == h) for h in range(24)]).alias("hour_counts"))
    gaps = with_previous(u.select("channel_id", "at", "video_id"), "channel_id", ["at", "video_id"], time_bucket("at", MONTH), ["at"])
    gaps = gaps.filter("prev is not null").withColumn("gap", (F.col("at") - F.col("prev.at")) / HOUR).drop("prev")
    stats = gaps.groupBy("channel_id").agg(F.avg("gap").alias("m"), F.stddev_pop("gap").alias("sd"), F.count("gap").alias("k"))
    median = exact_quantile(gaps, "channel_id", "gap", 0.5, "median")
    # lag-7 product: partner found by its position, so no channel is sorted as a whole
    placed = with_position(gaps, "channel_id", ["at", "video_id"], time_bucket("at", MONTH)).filter("n > 14").select("channel_id", "pos", "gap")
    z = placed.join(stats, "channel_id").select("channel_id", "pos", ((F.col("gap") - F.col("m")) / F.greatest("sd", F.lit(1e-6))).alias("z"))
    later = z.select("channel_id", (F.col("pos") - 7).alias("pos"), F.col("z").alias("z7"))
    acf = z.join(later, ["channel_id", "pos"]).groupBy("channel_id").agg(F.avg(F.col("z") * F.col("z7")).alias("acf"))
    j = counts.join(stats, "channel_id", "left").join(median, "channel_id", "left").join(acf, "channel_id", "left")
    enough = F.col("upload_count") >= 3
    share = lambda c, size: F.when(enough, F.transform(c, lambda x: rnd(x / F.col("upload_count"), 4))).otherwise(
        F.array_repeat(rnd(F.lit(1.0 / size), 4), size))
    cv = F.least(F.col("sd") / F.greatest("m", F.lit(1e-9)), F.lit(2.0))
    return j.select(
        "channel_id", "upload_count", *[rnd(F.when(enough, F.col(c)).otherwise(0.0), 4).alias(f"{n}_interval_hours")
                                        for c, n in (("m", "mean"), ("sd", "std"), ("median", "median"))],
        share("weekday_counts", 7).alias("weekday_distribution"), share("hour_counts", 24).alias("hour_distribution"),
        rnd(F.when(enough, F.coalesce(clip(F.abs("acf"), 0, 1), F.lit(0.0))).otherwise(0.0), 4).alias("periodicity_score"),
        rnd(F.when(F.col("k") > 2, F.col("median") / 24.0), 4).alias("dominant_period_days"),
        rnd(F.when(enough, 1 - cv / 2).otherwise(0.0), 4).alias("regularity"),
        rnd(F.when(enough, F.least(F.lit(0.95), 0.3 + F.col("upload_count") * 0.02)).otherwise(0.1), 4).alias("confidence"))


def break_spikes(uploads: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Unusually long gaps and the upload rates around them."""
    u = _stamped(uploads).select("channel_id", "at", "video_id")
    gaps = with_previous(u, "channel_id", ["at", "video_id"], time_bucket("at", MONTH), ["at"]).filter("prev is not null")
    gaps = gaps.select("channel_id", F.col("prev.at").alias("t0"), F.col("at").alias("t1"), F.col("video_id").alias("next_video"),
                       ((F.col("at") - F.col("prev.at")) / DAY).alias("gap"))
    stats = gaps.groupBy("channel_id").agg(F.avg("gap").alias("m"), F.stddev_pop("gap").alias("sd"), F.count(F.lit(1)).alias("k")).filter("k >= 4")
    odd = gaps.join(stats, "channel_id").filter(F.col("gap") > F.col("m") + threshold * F.greatest("sd", F.lit(1.0)))
    odd = odd.select("channel_id", "next_video", "t0", "t1", "gap", "m", "sd")
    pts = u.select("channel_id", F.col("at").alias("p"), F.col("at").alias("p2"))
    keys = ["channel_id", "next_video"]
    post = within(odd.select(*keys, "t1"), pts, "channel_id", "t1", "p", "p2", 0.0, WEEK, WEEK).groupBy(*keys).agg(F.count(F.lit(1)).alias("post"))
    pre = within(odd.select(*keys, "t0"), pts, "channel_id", "t0", "p", "p2", WEEK, 0.0, WEEK).groupBy(*keys).agg(F.count(F.lit(1)).alias("pre"))
    j = odd.join(post, keys).join(pre, keys)
    return j.select(
        "channel_id", F.timestamp_micros((F.col("t0") * 1e6).cast("long")).alias("break_start"), F.timestamp_micros((F.col("t1") * 1e6).cast("long")).alias("break_end"),
        rnd("gap", 4).alias("break_duration_days"), rnd(F.col("post") / 7.0, 4).alias("post_break_upload_rate"), rnd(F.col("pre") / 7.0, 4).alias("pre_break_upload_rate"),
        rnd((F.col("post") / 7.0) / F.greatest(F.col("pre") / 7.0, F.lit(0.01)), 4).alias("spike_ratio"),
        rnd(F.least(F.lit(1.0), (F.col("gap") - F.col("m")) / F.greatest(F.col("sd") * 3, F.lit(1.0))), 4).alias("anomaly_score"))


def infer_timezone(uploads: DataFrame) -> DataFrame:
    """Offset that puts most uploads between 8 and 20 local time; works on at most 1440 minute counts per channel."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    by_minute = uploads.groupBy("channel_id", minute.alias("minute")).agg(F.count(F.lit(1)).alias("c"))
    local = F.pmod(F.col("minute") + F.col("offset") * 60, F.lit(1440))
    tried = by_minute.withColumn("offset", F.explode(F.sequence(F.lit(-12), F.lit(12)))).groupBy("channel_id", "offset").agg(
        F.sum(F.when((local >= 480) & (local <= 1200), F.col("c")).otherwise(0)).alias("inside"), F.sum("c").alias("n"))
    best = tried.groupBy("channel_id").agg(F.max(F.struct("inside", (-F.col("offset")).alias("o"))).alias("b"), F.first("n").alias("n"))
    best = best.select("channel_id", "n", (-F.col("b.o")).alias("offset"), (F.col("b.inside") / F.col("n")).alias("share"))
    hours = by_minute.join(best, "channel_id").groupBy("channel_id", F.pmod(F.floor(F.col("minute") / 60) + F.col("offset"), F.lit(24)).alias("h")).agg(F.sum("c").alias("c"))
    peak = hours.groupBy("channel_id").agg(F.min_by("h", F.struct(-F.col("c"), F.col("h"))).alias("peak"))
    j = best.join(peak, "channel_id")
    enough = F.col("n") >= 10
    name = F.concat(F.lit("UTC"), F.when(F.col("offset") >= 0, "+").otherwise(""), F.col("offset").cast("string"))
    for offset, label in L.TIMEZONE_NAMES.items():
        name = F.when(F.col("offset") == offset, label).otherwise(name)
    return j.select(
        "channel_id", F.when(enough, F.col("offset")).otherwise(0).cast("double").alias("inferred_tz_offset"), F.when(enough, name).otherwise("UTC").alias("inferred_tz_name"),
        F.when(enough, F.col("peak")).otherwise(12).cast("long").alias("peak_local_hour"), rnd(F.when(enough, F.least(F.lit(0.9), F.col("share"))).otherwise(0.1), 4).alias("confidence"))


def stale(df: DataFrame, id_col: str, as_of: str, max_age_hours: int, order: list, limit: int = 20, condition=None) -> DataFrame:
    """Rows not crawled for ``max_age_hours`` (or never), in the given order."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"interval {max_age_hours} hours")
    old = df.filter(F.col("last_crawled_at").isNull() | (F.col("last_crawled_at") < cutoff))
    if condition is not None:
        old = old.filter(condition)
    return old.orderBy(*order, F.asc(id_col)).limit(limit)


def stale_videos(videos, as_of, limit=20):
    return stale(videos, "id", as_of, 168, [F.desc("priority_score")], limit, F.col("status") == "indexed")


def stale_channels(channels, as_of, limit=20):
    return stale(channels, "id", as_of, 336, [F.desc("priority_tier")], limit, F.col("is_active"))


# ---- videos: curves ----------------------------------------------------------------------

def _curve(spans: DataFrame, durations: DataFrame, width: float, kind: str) -> DataFrame:
    """Dense buckets with the largest value of the spans that touch them, 0 where none does.

    Empty buckets and touched ones are rows of one grouping, so no dense side is joined.
    """
    n = durations.select("video_id", F.greatest(F.floor(F.col("duration_s") / width), F.lit(1)).alias("n"))
    grid = n.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bucket"), F.lit(0.0).alias("v"))
    lo, hi = time_bucket("start_time", width), time_bucket("end_time", width)
    s = spans.filter("start_time is not null and v > 0").select("video_id", lo.alias("lo"), F.greatest(lo, hi).alias("hi"), F.col("v").cast("double").alias("v"))
    s = s.join(n, "video_id").filter("lo < n and hi >= 0")
    inside = F.sequence(F.greatest("lo", F.lit(0)), F.least("hi", F.col("n") - 1))
    both = grid.unionByName(s.select("video_id", F.explode(inside).alias("bucket"), "v"))
    return both.groupBy("video_id", "bucket").agg(F.max("v").alias("value")).select("video_id", F.lit(kind).alias("curve_type"), "bucket", "value")


def speech_rate_curve(segments: DataFrame, durations: DataFrame, width: float = 5.0) -> DataFrame:
    wps = F.size(T.raw_words("text")) / F.greatest(F.col("end_time") - F.col("start_time"), F.lit(0.1))
    return _curve(segments.select("video_id", "start_time", "end_time", wps.alias("v")), durations, width, "speech_rate")


def energy_curve(audio: DataFrame, durations: DataFrame, width: float = 2.0) -> DataFrame:
    return _curve(audio.select("video_id", "start_time", "end_time", energy("loudness_lufs", "speech_probability").alias("v")), durations, width, "energy")


def music_density_curve(audio: DataFrame, durations: DataFrame, width: float = 5.0) -> DataFrame:
    return _curve(audio.select("video_id", "start_time", "end_time", F.coalesce("music_probability", F.lit(0.0)).alias("v")), durations, width, "music_density")


def curve_summary(curve: DataFrame) -> DataFrame:
    return curve.groupBy("video_id", "curve_type").agg(
        F.count(F.lit(1)).alias("buckets"), rnd(F.min("value"), 4).alias("min_val"), rnd(F.max("value"), 4).alias("max_val"),
        rnd(F.avg("value"), 4).alias("mean_val"), rnd(std0("value"), 4).alias("std_val"))


def window_stats(curve: DataFrame, start_s: float, end_s: float, rate_hz: float) -> DataFrame:
    lo, hi = max(0, int(start_s * rate_hz)), int(end_s * rate_hz)
    part = F.when((F.col("bucket") >= lo) & (F.col("bucket") < hi), F.col("value"))
    def zero(c):
        return F.coalesce(rnd(c, 4), F.lit(0.0))
    return curve.groupBy("video_id", "curve_type").agg(
        zero(F.avg(part)).alias("mean"), zero(F.max(part)).alias("max"), zero(F.min(part)).alias("min"), zero(F.stddev_pop(part)).alias("std"))


def sliding_windows(measures: DataFrame, durations: DataFrame, values: list[str], width: float = 5.0, hop: float = 2.5, key: str = "video_id", at: str = "at") -> DataFrame:
    """Means of raw measures in windows that start every hop: (key, start_time, end_time, n, mean_<value>...).

    Windows of a video begin at k * hop while at least half a window is left; the last ends with the video. A window without a measure
    stays, with n = 0 and null means; measures outside the windows, and of videos without a duration, count nowhere. A measure goes to its
    few windows as rows, and windows are the groups, so a long video spreads over many of them.
    """
    last = F.floor((F.col("duration_s") - width / 2) / hop).cast("long")
    frame = durations.filter(F.col("duration_s") >= width / 2).select(key, "duration_s", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    own = F.floor(F.col(at) / hop).cast("long")
    covered = F.filter(F.sequence(own - math.ceil(width / hop), own), lambda k: (k >= 0) & (k * hop <= F.col(at)) & (F.col(at) < k * hop + width))
    parts = measures.filter(F.col(at).isNotNull()).select(key, F.explode(covered).alias("k"), *values).groupBy(key, "k").agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])
    start = F.col("k") * hop
    return frame.join(parts.hint(DENSE), [key, "k"], "left").select(key, start.alias("start_time"), F.least(start + width, F.col("duration_s")).alias("end_time"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), *[f"mean_{v}" for v in values])


def silence(audio: DataFrame, durations: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Gaps between windows: total, mean, longest, count, pauses of 0.8 to 3.5 s."""
    a = audio.select("video_id", "id", "start_time", "end_time", F.coalesce("speech_probability", F.lit(0.5)).alias("sp"))
    a = with_running(a, "video_id", ["start_time", "id"], time_bucket("start_time", 600), F.col("end_time"), "seen", "max", inclusive=False)
    a = a.withColumn("seen", F.greatest(F.coalesce("seen", F.lit(0.0)), F.lit(0.0)))
    gap = F.when((F.col("start_time") > F.col("seen") + 0.5) & (F.col("sp") < threshold), F.col("start_time") - F.col("seen"))
    g = a.withColumn("gap", gap).groupBy("video_id").agg(
        F.coalesce(F.sum("gap"), F.lit(0.0)).alias("t"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("m"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("x"),
        F.count("gap").alias("gap_count"), F.count_if(F.col("gap").between(0.8, 3.5)).alias("dramatic_pause_count"))
    return g.join(durations, "video_id").select(
        "video_id", rnd("t", 3).alias("total_silence_seconds"), rnd(F.col("t") / F.greatest("duration_s", F.lit(1.0)), 4).alias("silence_ratio"),
        rnd("m", 3).alias("mean_gap_duration"), rnd("x", 3).alias("max_gap_duration"), "gap_count", "dramatic_pause_count")


def derived_metrics(speech: DataFrame, energy_: DataFrame) -> DataFrame:
    """Ramp, decay and pacing from the dense curves."""
    n = energy_.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("em"), F.stddev_pop("value").alias("es"))
    q = energy_.hint(DENSE).join(n, "video_id").groupBy("video_id").agg(
        F.first("n").alias("n"), F.first("em").alias("em"), F.first("es").alias("es"),
        F.avg(F.when(F.col("bucket") < F.floor(F.col("n") / 4), F.col("value"))).alias("q1"),
        F.avg(F.when(F.col("bucket") >= F.floor(F.col("n") * 3 / 4), F.col("value"))).alias("q4"))
    m = speech.groupBy("video_id").agg(F.count(F.lit(1)).alias("sn"))
    h = speech.hint(DENSE).join(m, "video_id").groupBy("video_id").agg(
        F.first("sn").alias("sn"), F.avg(F.when(F.col("bucket") < F.floor(F.col("sn") / 2), F.col("value"))).alias("h1"),
        F.avg(F.when(F.col("bucket") >= F.floor(F.col("sn") / 2), F.col("value"))).alias("h2"))
    j = q.join(h, "video_id", "left")
    ramp = F.when(F.col("n") > 4, clip((F.col("q4") - F.col("q1")) / F.greatest("q1", F.lit(0.01)) * 0.5 + 0.5, 0, 1)).otherwise(0.5)
    decay = F.when(F.col("sn") > 4, clip((F.col("h1") - F.col("h2")) / F.greatest("h1", F.lit(0.01)), 0, 1)).otherwise(0.3)
    cv = F.col("es") / F.greatest("em", F.lit(0.01))
    pacing = F.when(F.col("es") > 1e-9, clip(1.0 - F.abs(cv - 0.4) * 2, 0, 1)).otherwise(0.3)
    return j.select("video_id", rnd(ramp, 3).alias("excitement_ramp_score"), rnd(decay, 3).alias("attention_decay_probability"),
                    rnd(pacing, 3).alias("pacing_quality_score"), rnd(F.least(F.lit(0.85), 0.4 + F.col("n") * 0.001), 3).alias("confidence"))


def highlights(speech: DataFrame, energy_: DataFrame, rate_hz: float = 0.5, first: int = 20) -> DataFrame:
    """First peaks of energy plus speech, bucket by bucket, above the 85th percentile."""
    n = energy_.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 10").select("video_id")
    both = energy_.hint(DENSE).join(n, "video_id", "left_semi").select("video_id", "bucket", "value").join(
        speech.select("video_id", "bucket", F.col("value").alias("s")).hint(DENSE), ["video_id", "bucket"])
    both = cut_lineage(both.select("video_id", "bucket", rnd(F.col("value") + F.col("s"), 9).alias("v")))
    cut = exact_quantile(both, "video_id", "v", 0.85, "threshold")
    from .ordered import top_n_per_key
    peaks = both.hint(DENSE).join(cut, "video_id").filter(F.col("v") > F.col("threshold") + 1e-9)
    prob = F.least(F.lit(1.0), (F.col("v") - F.col("threshold")) / F.greatest("threshold", F.lit(0.01)))
    peaks = peaks.select("video_id", "bucket", rnd(F.col("bucket") / rate_hz, 3).alias("timestamp"), rnd(prob, 3).alias("probability"))
    return top_n_per_key(peaks, "video_id", [F.asc("bucket")], first).drop("bucket")


def info_density(speech: DataFrame, energy_: DataFrame, durations: DataFrame, speech_rate: float = 0.2, energy_rate: float = 0.5) -> DataFrame:
    """Density per minute of video from both curves."""
    def by_minute(curve, rate, name):
        minute = F.floor((F.col("bucket") + 1e-9) / (60 * rate)).cast("long")
        return curve.groupBy("video_id", minute.alias("minute")).agg(F.avg("value").alias(name)).hint(DENSE)
    count = F.greatest(F.floor(F.col("duration_s") / 60), F.lit(1))
    grid = durations.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("minute"))
    j = grid.join(by_minute(speech, speech_rate, "s"), ["video_id", "minute"], "left").join(by_minute(energy_, energy_rate, "e"), ["video_id", "minute"], "left")
    return j.select("video_id", "minute", rnd(F.coalesce("s", F.lit(0.0)) * 30 + F.coalesce("e", F.lit(0.0)) * 20, 1).alias("density"))


# ---- evolution ---------------------------------------------------------------------------

def creator_evolution(videos: DataFrame) -> DataFrame:
    """Trends over a channel's videos in upload order, with the mean production score of its thirds.

    Needs channel_id, id, ts and the signals intro_duration_s, speaking_rate_wpm, unique_word_count, has_sponsor,
    cut_frequency_per_min, mic_quality_score, has_captions (null signals take their defaults).
    """
    defaults = {"intro_duration_s": 5.0, "speaking_rate_wpm": 150.0, "unique_word_count": 500.0, "cut_frequency_per_min": 5.0, "mic_quality_score": 0.5}
    v = videos.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(x)) for c, x in defaults.items()})
    v = v.withColumn("sponsor", F.when(F.coalesce("has_sponsor", F.lit(False)), 1.0).otherwise(0.0)).withColumn("at", whole_number_seconds("ts"))
    one = F.lit(1.0)
    score = (F.least(one, "mic_quality_score") * 0.25 + F.least(one, F.col("cut_frequency_per_min") / 20) * 0.25
             + F.when(F.coalesce("has_captions", F.lit(False)), 1.0).otherwise(0.5) * 0.25 + F.least(one, F.col("unique_word_count") / 2000) * 0.25)
    v = v.withColumn("score", rnd(score, 3))
    v = with_position(v, "channel_id", ["at", "id"], time_bucket("at", 12 * MONTH))
    third = F.greatest(F.floor(F.col("n") / 3), F.lit(1))
    pos = F.col("pos").cast("double")
    trend = lambda c, d, name: F.coalesce(rnd(F.regr_slope(F.col(c), pos), d), F.lit(0.0)).alias(name)
    g = v.groupBy("channel_id").agg(
        F.first("n").alias("video_count"), F.min("ts").alias("first_video"), F.max("ts").alias("latest_video"),
        trend("intro_duration_s", 4, "intro_length_drift"), trend("speaking_rate_wpm", 4, "speech_speed_drift"),
        trend("unique_word_count", 2, "vocabulary_growth_rate"), trend("sponsor", 4, "sponsor_density_trend"),
        trend("cut_frequency_per_min", 4, "editing_complexity_trend"),
        rnd(F.avg(F.when(F.col("pos") < third, F.col("score"))), 3).alias("early"),
        rnd(F.avg(F.when((F.col("pos") >= third) & (F.col("pos") < 2 * third), F.col("score"))), 3).alias("mid"),
        rnd(F.avg(F.when(F.col("pos") >= 2 * third, F.col("score"))), 3).alias("recent"))
    few = F.col("video_count") < 3
    drifts = ["intro_length_drift", "speech_speed_drift", "vocabulary_growth_rate", "sponsor_density_trend", "editing_complexity_trend"]
    return g.select(
        "channel_id", "video_count", *[F.when(few, None).otherwise(F.col(c)).alias(c) for c in ("first_video", "latest_video")],
        *[F.when(few, 0.0).otherwise(F.col(c)).alias(c) for c in drifts], *[F.when(~few, F.col(c)).alias(c) for c in ("early", "mid", "recent")],
        rnd(F.when(few, 0.1).otherwise(F.least(F.lit(0.85), 0.3 + F.col("video_count") * 0.01)), 3).alias("confidence"))


def production_curve(videos: DataFrame) -> DataFrame:
    """Production score per video in order, the long form of a channel's curve."""
    v = videos.withColumn("at", whole_number_seconds("ts"))
    return with_position(v, "channel_id", ["at", "id"], time_bucket("at", 12 * MONTH))


# ---- declared series ---------------------------------------------------------------------

def seasonal(uploads: DataFrame, lags: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """Autocorrelation of dense daily counts at a few lags, peak weekday and hour.

    Days without uploads count as zeros, which add nothing to the sums of a correlation, so only days with uploads are rows.
    """
    daily = uploads.groupBy("channel_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    span = daily.groupBy("channel_id").agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
    span = span.withColumn("days", F.datediff("d1", "d0") + 1)

    def sums(lag):
        later, earlier = F.col("day") >= F.date_add("d0", lag), F.col("day") <= F.date_sub("d1", lag)
        return [F.coalesce(F.sum(F.when(w, x)), F.lit(0.0)).alias(f"{n}_{lag}") for n, w, x in (
            ("y", later, F.col("c")), ("yy", later, F.col("c") * F.col("c")), ("x", earlier, F.col("c")), ("xx", earlier, F.col("c") * F.col("c")))]

    out = daily.join(span, "channel_id").groupBy("channel_id").agg(F.first("days").alias("days"), *[x for lag in lags for x in sums(lag)])
    past = daily.select("channel_id", F.explode(F.array(*[F.lit(lag) for lag in lags])).alias("lag"), "day", F.col("c").alias("p"))
    met = past.select("channel_id", "lag", F.expr("date_add(day, lag)").alias("day"), "p").hint(DENSE).join(daily, ["channel_id", "day"])
    met = met.groupBy("channel_id").agg(*[F.sum(F.when(F.col("lag") == lag, F.col("c") * F.col("p"))).alias(f"xy_{lag}") for lag in lags])
    out = out.join(met, "channel_id", "left")
    for lag in lags:
        n, (x, y, xx, yy) = F.col("days") - lag, [F.col(f"{s}_{lag}") for s in ("x", "y", "xx", "yy")]
        spread = F.sqrt(n * xx - x * x) * F.sqrt(n * yy - y * y)
        r = (n * F.coalesce(f"xy_{lag}", F.lit(0.0)) - x * y) / F.nullif(spread, F.lit(0.0))
        out = out.withColumn(f"acf_{lag}", F.when(F.col("days") >= lag + 2, rnd(r, 4)))
    out = out.select("channel_id", *[f"acf_{lag}" for lag in lags])
    when = uploads.groupBy("channel_id", F.weekday("ts").alias("d")).agg(F.count(F.lit(1)).alias("c")).groupBy("channel_id").agg(
        F.min_by("d", F.struct(-F.col("c"), F.col("d"))).cast("long").alias("peak_weekday"))
    hour = uploads.groupBy("channel_id", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("c")).groupBy("channel_id").agg(
        F.min_by("h", F.struct(-F.col("c"), F.col("h"))).cast("long").alias("peak_hour"))
    strength = F.greatest(F.lit(0.0), *[F.coalesce(f"acf_{lag}", F.lit(0.0)) for lag in lags])
    return out.withColumn("strength", strength).join(when, "channel_id").join(hour, "channel_id")


def growth(snapshots: DataFrame, value: str = "subscriber_count") -> DataFrame:
    """Growth of a counter over 30 and 90 days before the latest snapshot, and its projection."""
    s = snapshots.select("channel_id", "snapshot_ts", F.col(value).cast("double").alias("v"))
    latest = s.groupBy("channel_id").agg(F.max("snapshot_ts").alias("t"), F.max_by("v", F.struct("snapshot_ts", "v")).alias("latest"))
    j = s.join(latest, "channel_id")

    def as_of(days):
        cut = F.col("t") - F.expr(f"interval {days} days")
        return F.max(F.when(F.col("snapshot_ts") <= cut, F.struct("snapshot_ts", "v")))["v"]

    g = j.groupBy("channel_id").agg(F.first("latest").alias("latest"), as_of(30).alias("v30"), as_of(90).alias("v90"))
    r30, r90 = [F.when(F.col(c) != 0, (F.col("latest") - F.col(c)) / F.col(c)) for c in ("v30", "v90")]
    return g.withColumn("r30", r30).withColumn("r90", r90).select(
        "channel_id", "latest", rnd("r30", 4).alias("growth_30d"), rnd("r90", 4).alias("growth_90d"),
        rnd(F.col("r30") - F.col("r90") / 3, 4).alias("acceleration"), (F.signum("r30") != F.signum("r90")).alias("inflection"),
        rnd(F.col("latest") * (1 + F.col("r30")), 2).alias("projected"))


def scene_pacing(frames: DataFrame) -> DataFrame:
    """Durations between scene changes: mean, spread, trend, regularity."""
    cuts = frames.filter("is_scene_change").select("video_id", "id", "timestamp")
    d = with_previous(cuts, "video_id", ["timestamp", "id"], time_bucket("timestamp", 600), ["timestamp"]).filter("prev is not null")
    d = d.withColumn("dur", F.col("timestamp") - F.col("prev.timestamp")).drop("prev")
    d = with_position(d, "video_id", ["timestamp", "id"], time_bucket("timestamp", 600))
    g = d.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("scenes"), F.avg("dur").alias("m"), F.stddev_pop("dur").alias("sd"), F.regr_slope("dur", F.col("pos").cast("double")).alias("slope"))
    return g.select("video_id", "scenes", rnd("m", 3).alias("mean_duration"), rnd("sd", 3).alias("std_duration"), rnd("slope", 4).alias("trend"),
                    rnd(F.greatest(F.lit(0.0), 1 - F.col("sd") / F.greatest("m", F.lit(1e-9))), 4).alias("regularity"))
