"""Audio windows: change points, transcript alignment, transcript and on-screen text clean-up."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import clip, rnd, total
from ..functions.scores import lufs_to_linear
from ..session import cut_lineage
from .aggregates import quality_level
from .joins import overlapping
from .ordered import time_bucket, with_neighbours, with_previous

# --- fixed: change point thresholds
SOURCE_DELTA, ENERGY_RATIO, SPECTRAL, HARMONIC, ONSET, MIN_MAGNITUDE = 0.40, 3.0, 0.35, 0.30, 0.3, 0.25
NAMED_TRANSITIONS = [
    "silence_to_music", "music_to_silence", "silence_to_speech", "speech_to_silence", "music_to_speech", "speech_to_music",
]
# --- fixed: alignment weights
ALIGNMENT_WEIGHTS = {"speech_density": 0.30, "asr_confidence": 0.30, "timing_coherence": 0.20, "silence_gap": 0.20}
BLOCK = 600.0


def _signal(kind: Column | str, magnitude: Column, source: Column, target: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(magnitude.alias("magnitude"), kind.alias("type"), source.alias("from_state"), target.alias("to_state"))


def change_signals(windows: DataFrame) -> DataFrame:
    """Signals between each window and the one before it in the video: array of structs in a fixed order."""
    fields = ["music_probability", "speech_probability", "dominant_source", "loudness_lufs", "spectral_centroid", "harmonic_ratio", "event_tags"]
    w = with_previous(windows, "video_id", ["start_time", "id"], time_bucket("start_time", BLOCK), fields).filter("prev is not null")

    def now(c, default=None):
        return F.coalesce(F.col(c), F.lit(default)) if default is not None else F.col(c)

    def before(c, default=None):
        return F.coalesce(F.col(f"prev.{c}"), F.lit(default)) if default is not None else F.col(f"prev.{c}")

    delta = F.greatest(F.abs(now("music_probability", 0.0) - before("music_probability", 0.0)),
                       F.abs(now("speech_probability", 0.0) - before("speech_probability", 0.0)))
    src, dst = before("dominant_source", "unknown"), now("dominant_source", "unknown")
    named = F.concat(src, F.lit("_to_"), dst)
    source_kind = F.when((src != dst) & (delta > 0.3), F.when(named.isin(NAMED_TRANSITIONS), named).otherwise("spectral_shift")).otherwise("unknown")
    l0, l1 = before("loudness_lufs", -30.0), now("loudness_lufs", -30.0)
    up = lufs_to_linear(l1) / lufs_to_linear(l0)
    down = lufs_to_linear(l0) / lufs_to_linear(l1)
    energy_kind = F.when(up > ENERGY_RATIO, "energy_spike").when(down > ENERGY_RATIO, "energy_drop").otherwise("unknown")
    energy = F.least(F.lit(1.0), (F.greatest(up, down) - 1.0) / 5.0)
    c0, c1 = before("spectral_centroid", 2000.0), now("spectral_centroid", 2000.0)
    spectral = F.least(F.lit(1.0), F.abs(c1 - c0) / F.greatest((c0 + c1) / 2 + F.lit(1e-8), F.lit(1.0)) * 2)
    h0, h1 = before("harmonic_ratio", 0.5), now("harmonic_ratio", 0.5)
    harmonic = F.least(F.lit(1.0), F.abs(h1 - h0) * 3)

    def known(label):
        old = F.filter(F.col("prev.event_tags"), lambda t: t["label"] == label)
        return F.when(F.size(old) > 0, F.element_at(old, -1)["confidence"]).otherwise(0.0)

    risen = F.filter("event_tags", lambda t: (t["confidence"] - known(t["label"]) > ONSET) & (t["confidence"] > 0.3))
    lufs = lambda x: F.format_string("%.0f LUFS", x)
    w = w.withColumns({"_source": delta, "_energy": energy, "_ratio": up, "_spectral": spectral, "_harmonic": harmonic, "_risen": risen})
    onset_label = F.get("_risen", F.lit(0))["label"]
    onset = F.least(F.lit(1.0), (F.get("_risen", F.lit(0))["confidence"] - known(onset_label)) * 1.5)
    hz = lambda x: F.format_string("%.0f Hz", x)
    tone = lambda x: F.format_string("harmonic=%.2f", x)
    empty = F.lit("")
    quiet = energy_kind == "unknown"
    signals = F.array_compact(F.array(
        F.when(F.col("_source") > SOURCE_DELTA, _signal(source_kind, F.col("_source"), src, dst)),
        F.when(F.col("_energy") > 0.3, _signal(energy_kind, F.col("_energy"), F.when(quiet, empty).otherwise(lufs(l0)), F.when(quiet, empty).otherwise(lufs(l1)))),
        F.when(F.col("_spectral") > SPECTRAL, _signal("spectral_shift", F.col("_spectral"), hz(c0), hz(c1))),
        F.when(F.col("_harmonic") > HARMONIC, _signal("harmonic_shift", F.col("_harmonic"), tone(h0), tone(h1))),
        F.when((F.size("_risen") > 0) & (onset > 0.3), _signal("event_onset", onset, src, onset_label)),
    ))
    return w.select(
        "video_id", "id", F.col("start_time").alias("timestamp"), signals.alias("signals"), F.col("_source").alias("event_delta"),
        F.col("_ratio").alias("energy_ratio"), F.col("_spectral").alias("spectral_distance"), F.col("_harmonic").alias("harmonic_shift"))


def raw_change_points(windows: DataFrame) -> DataFrame:
    """Strongest signal per window border (first on ties), raised when several agree."""
    s = change_signals(windows)
    best = F.aggregate("signals", F.get("signals", F.lit(0)), lambda acc, x: F.when(x["magnitude"] > acc["magnitude"], x).otherwise(acc))
    n = F.size("signals")
    s = s.filter(n > 0).withColumn("best", best)
    m = F.col("best.magnitude")
    m = F.when(n >= 2, F.least(F.lit(1.0), m * 1.2)).otherwise(m)
    m = F.when(n >= 3, F.least(F.lit(1.0), m * 1.15)).otherwise(m)
    return s.withColumn("magnitude", m).filter(F.col("magnitude") >= MIN_MAGNITUDE).select(
        "video_id", "id", "timestamp", "magnitude", F.col("best.type").alias("transition_type"), F.col("best.from_state").alias("from_state"),
        F.col("best.to_state").alias("to_state"), "event_delta", "energy_ratio", "spectral_distance", "harmonic_shift")


def _carry_folds(blocks: DataFrame, key: str, fold, start: Column, max_rounds: int = 100_000) -> DataFrame:
    """Left fold over the blocks of a key in order, all blocks at once.

    ``fold(incoming)`` gives a block's result struct with a field ``out``, the state it hands on. Every round
    feeds each block the state its predecessor ended with in the round before, until nothing changes. Blocks
    soon forget what they were given, so a few rounds are enough; correctness does not depend on that.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(key).orderBy("block")
    state = cut_lineage(blocks.withColumn("_in", start).withColumn("_res", fold(F.col("_in"))))
    for _ in range(max_rounds):
        # only the small hand-over state goes through the per-key window, not the rows of the blocks
        handed = state.select(key, "block", F.coalesce(F.lag("_res.out").over(w), start).alias("_next"))
        again = state.join(handed, [key, "block"])
        stale = again.filter(~F.col("_next").eqNullSafe(F.col("_in")))
        if stale.isEmpty():
            return state
        state = cut_lineage(again.drop("_in", "_res").withColumnRenamed("_next", "_in").withColumn("_res", fold(F.col("_in"))))
    raise RuntimeError("fold did not settle")


def suppress_nearby(points: DataFrame, min_gap: float = 3.0, block: float = BLOCK) -> DataFrame:
    """Walk each video in time order; a point closer than ``min_gap`` to the last kept one replaces it only if stronger."""
    points = cut_lineage(points)  # read for the walk and again for what it keeps
    fields = F.struct(F.col("timestamp").alias("t"), F.col("id").alias("id"), F.col("magnitude").alias("m"))
    blocks = points.groupBy("video_id", time_bucket("timestamp", block).alias("block")).agg(F.array_sort(F.collect_list(fields)).alias("pts"))
    last = "struct<t:double,id:bigint,m:double>"
    kept = f"struct<done:array<bigint>,out:{last}>"

    def fold(incoming):
        # done: points settled while in this block, the incoming one included once a later point closes it
        begin = F.struct(F.array().cast("array<bigint>").alias("done"), incoming.alias("out")).cast(kept)

        def step(acc, p):
            close = acc["out"].isNotNull() & (p["t"] - acc["out"]["t"] < min_gap)
            keep_old = close & ~(p["m"] > acc["out"]["m"])
            return F.struct(
                F.when(close | acc["out"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["out"]["id"]))).alias("done"),
                F.when(keep_old, acc["out"]).otherwise(p).alias("out")).cast(kept)

        return F.aggregate("pts", begin, step)

    done = _carry_folds(blocks, "video_id", fold, F.lit(None).cast(last))
    settled = done.select("video_id", F.explode("_res.done").alias("id"))
    final = done.groupBy("video_id").agg(F.max_by("_res.out", "block").alias("o")).select("video_id", F.col("o.id").alias("id"))
    return points.join(settled.unionByName(final), ["video_id", "id"], "left_semi")


def change_points(windows: DataFrame, min_gap: float = 3.0) -> DataFrame:
    return suppress_nearby(raw_change_points(windows), min_gap)


# ---- alignment ---------------------------------------------------------------------------

def align(segments: DataFrame, windows: DataFrame, cell: float = 30.0) -> DataFrame:
    """Score of each transcript segment against the audio windows it overlaps."""
    seg = segments.select("id", "video_id", F.col("start_time").alias("s0"), F.col("end_time").alias("s1"),
                          F.size(T.raw_words("text")).alias("wc"), F.coalesce("confidence", F.lit(0.5)).alias("conf"))  # no text is shuffled
    win = windows.select("video_id", F.col("start_time").alias("w0"), F.col("end_time").alias("w1"),
                         F.coalesce("speech_probability", F.lit(0.0)).alias("sp"), F.coalesce("music_probability", F.lit(0.0)).alias("mp"))
    hit = overlapping(seg.select("id", "video_id", "s0", "s1"), win, "video_id", ("s0", "s1"), ("w0", "w1"), cell).groupBy("id").agg(
        F.avg("sp").alias("speech"), F.count(F.lit(1)).alias("n"), F.count_if((F.col("sp") < 0.1) & (F.col("mp") < 0.1)).alias("silent"))
    # segments of videos without audio stay out, as there is nothing to compare with
    seg = seg.join(win.select("video_id").distinct(), "video_id", "left_semi").join(hit, "id", "left")
    seg = seg.withColumns({
        "speech": F.coalesce("speech", F.lit(0.0)), "n": F.coalesce("n", F.lit(0)), "silent": F.coalesce("silent", F.lit(0)),
        "len": F.greatest(F.col("s1") - F.col("s0"), F.lit(0.1))})
    wps, loud = F.col("wc") / F.col("len"), F.col("speech") > 0.5
    unheard = (F.col("speech") < 0.2) & (F.col("wc") > 5)
    density = F.when(loud, F.when(wps < 0.5, 0.2).when(wps > 6.0, 0.5).otherwise(F.least(F.lit(1.0), wps / 2.5))).when(unheard, 0.3).otherwise(1.0)
    doubtful = (F.col("conf") < 0.3) & loud
    asr = F.when(doubtful, 0.2).when(F.col("conf") < 0.5, F.col("conf") * 0.8).otherwise(F.col("conf"))
    fit = F.col("len") / F.greatest(F.col("wc") / 2.5, F.lit(0.1))
    timing = F.when(F.col("wc") == 0, 1.0).when(fit < 0.3, 0.3).when(fit > 5.0, 0.4).otherwise(F.least(F.lit(1.0), 1.0 - F.abs(1.0 - fit) * 0.3))
    share = F.col("silent") / F.greatest("n", F.lit(1))
    silence = F.when(F.col("n") == 0, 1.0).when((share > 0.7) & (F.col("wc") > 3), 0.2).when((share > 0.4) & (F.col("wc") > 3), 0.5).otherwise(1.0 - share * 0.3)
    seg = seg.withColumns({"speech_density": density, "asr_confidence": asr, "timing_coherence": timing, "silence_gap": silence})
    score = clip(total([F.col(c) * w for c, w in ALIGNMENT_WEIGHTS.items()]), 0, 1)
    warnings = F.array_compact(F.array(
        F.when(loud & (wps < 0.5), "speech without transcript"), F.when(loud & (wps > 6.0), "transcript denser than speech"),
        F.when(~loud & unheard, "transcript without speech"), F.when(doubtful, "low transcript confidence"),
        F.when((F.col("wc") > 0) & (fit < 0.3), "duration does not fit word count"),
        F.when((F.col("n") > 0) & (share > 0.7) & (F.col("wc") > 3), "silence under transcript")))
    # a hair above the border so that the order of summation does not move a level
    return seg.withColumn("alignment_score", score).select(
        "id", "video_id", F.col("s0").alias("start_time"), F.col("s1").alias("end_time"), "alignment_score",
        quality_level(F.col("alignment_score") + 1e-9).alias("quality_level"), *ALIGNMENT_WEIGHTS, warnings.alias("warnings"))


# ---- transcript and on-screen text -------------------------------------------------------

def drop_hallucinations(segments: DataFrame) -> DataFrame:
    return segments.filter(~T.is_hallucination("text", "start_time", "end_time"))


def chunk_transcript(asr: DataFrame, target: float = 15.0, overlap: float = 2.0, block: float = BLOCK) -> DataFrame:
    """Recogniser pieces merged until a chunk lasts ``target`` seconds; starts pulled back into the chunk before.

    Needs (video_id, start, end, text, avg_log_prob). Only the chunk start is carried from piece to piece; the
    texts are gathered afterwards per chunk, whose length the target bounds.
    """
    p = asr.withColumn("clean", T.clean_filler("text")).withColumn("raw_ok", F.trim("text") != "")
    # a piece without text opens a chunk but adds nothing to it
    piece = F.struct(F.col("start").alias("s"), F.col("end").alias("e"), (F.col("raw_ok") & (F.col("clean") != "")).alias("ok"))
    blocks = p.groupBy("video_id", time_bucket("start", block).alias("block")).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    row = "struct<s:double,e:double,c:double>"
    res = f"struct<rows:array<{row}>,out:double>"

    def fold(incoming):
        begin = F.struct(F.array().cast(f"array<{row}>").alias("rows"), incoming.alias("out")).cast(res)

        def step(acc, x):
            opened = F.coalesce(acc["out"], x["s"])
            full = x["ok"] & (x["e"] - opened >= target)
            return F.struct(
                F.when(x["ok"], F.concat(acc["rows"], F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), opened.alias("c"))))).otherwise(acc["rows"]).alias("rows"),
                F.when(full, F.lit(None).cast("double")).otherwise(opened).alias("out")).cast(res)

        return F.aggregate("pieces", begin, step)

    placed = _carry_folds(blocks, "video_id", fold, F.lit(None).cast("double"))
    chunk_of = placed.select("video_id", F.explode("_res.rows").alias("r")).select("video_id", F.col("r.s").alias("start"), F.col("r.e").alias("end"), F.col("r.c").alias("chunk"))
    chunk_of = chunk_of.groupBy("video_id", "start", "end").agg(F.min("chunk").alias("chunk"))
    rows = p.filter(F.col("raw_ok") & (F.col("clean") != "")).join(chunk_of, ["video_id", "start", "end"])
    conf = clip(F.lit(1.0) + F.col("avg_log_prob"), 0, 1)
    last = asr.groupBy("video_id").agg(F.max("end").alias("video_end"))
    chunks = rows.groupBy("video_id", "chunk").agg(
        F.max("end").alias("end_time"), F.avg(conf).alias("c"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "clean"))), lambda x: x["clean"]), " ").alias("text"))
    chunks = chunks.join(last, "video_id").withColumn(
        "end_time", F.when(F.col("end_time") - F.col("chunk") < target, F.col("video_end")).otherwise(F.col("end_time")))
    chunks = with_previous(chunks, "video_id", ["chunk"], time_bucket("chunk", block), ["chunk", "end_time"])
    pulled = F.greatest(F.col("prev.chunk"), F.col("prev.end_time") - overlap)
    return chunks.select("video_id", rnd(F.least("chunk", F.coalesce(pulled, "chunk")), 2).alias("start_time"), rnd("end_time", 2).alias("end_time"),
                         "text", rnd("c", 3).alias("confidence"))


def scene_changes(frames: DataFrame, threshold: float = 30.0) -> DataFrame:
    """Chi-square distance of consecutive length-normalised colour histograms."""
    n = F.sqrt(F.aggregate("histogram", F.lit(0.0), lambda s, x: s + x * x))
    f = frames.withColumn("h", F.transform("histogram", lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    f = with_previous(f, "video_id", ["timestamp", "id"], time_bucket("timestamp", BLOCK), ["h"])
    terms = F.zip_with("prev.h", "h", lambda a, b: F.when(F.abs(a) > 1e-12, (a - b) * (a - b) / a).otherwise(0.0))
    d = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return f.select("id", "video_id", "timestamp", d.alias("distance"), F.coalesce(d > threshold, F.lit(False)).alias("is_scene_change"))


def merge_ocr(tokens: DataFrame) -> DataFrame:
    """Best reading per token of two engines; agreement and digits raise its confidence."""
    t = tokens.filter("text is not null").groupBy("frame_id", F.lower("text").alias("tok")).agg(
        F.max_by("text", F.struct("confidence", "text")).alias("text"), F.max("confidence").alias("conf"), F.count_distinct("engine").alias("engines"))
    boost = F.when(F.col("engines") > 1, 1.2).otherwise(1.0) * F.when(F.col("text").rlike(r"^\d[\d,.:]*\d?$"), 1.1).otherwise(1.0)
    adj = F.least(F.col("conf") * boost, F.lit(1.0))
    g = t.withColumn("adj", adj).groupBy("frame_id").agg(
        F.avg("adj").alias("c"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("o"), "tok", "text"))), lambda x: x["text"]).alias("tokens"))
    return g.select("frame_id", F.array_join("tokens", " ").alias("text"), rnd("c", 4).alias("confidence"))


def smooth_ocr(frames: DataFrame) -> DataFrame:
    """Keep tokens seen in a neighbouring frame or starting with a digit; a text without any is kept at less confidence."""
    b = time_bucket("timestamp", BLOCK)
    order = ["timestamp", "id"]
    f = with_neighbours(frames, "video_id", order, b, ["ocr_text"])
    around = F.concat(T.words("prev.ocr_text"), T.words("next.ocr_text"))
    f = f.withColumn("_near", around).withColumn("_own", T.raw_words("ocr_text"))
    kept = F.filter("_own", lambda t: F.array_contains(F.col("_near"), F.lower(t)) | t.rlike(r"^\d"))
    f = f.withColumn("_kept", kept)
    single = F.col("prev").isNull() & F.col("next").isNull()
    blank = (F.size("_own") == 0) | single
    return f.select(
        "id", "video_id", "timestamp",
        F.when(blank | (F.size("_kept") == 0), F.col("ocr_text")).otherwise(F.array_join("_kept", " ")).alias("ocr_text"),
        F.when(blank, F.col("ocr_confidence")).when(F.size("_kept") > 0, F.least(F.col("ocr_confidence") * 1.1, F.lit(1.0)))
        .otherwise(F.col("ocr_confidence") * 0.75).alias("ocr_confidence"))
