"""Named queries: joins in time, audio, curves, channel rhythm."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicons import ASR_FILLERS
from ..operators import aggregates as G
from ..operators import audio as U
from ..operators import filters as L
from ..operators import joins as J
from ..operators import temporal as B
from ..sources import adapters as A
from .catalog_scalars import LOOPED, LOOPS
from .models_sql import clip, in_list, r, raw_words, sql, words

AS_OF = "2001-08-02"


def audio_durations(s, d):
    return A.audio_windows(s, d).groupBy("video_id").agg(F.max("end_time").alias("duration_s"))


def text_durations(s, d):
    return A.segments(s, d).groupBy("video_id").agg(F.max("end_time").alias("duration_s"))


def timed_comments(s, d):
    """Comments that quote two times, one of them outside most videos."""
    return A.comments(s, d).select("id", F.col("video_id"), F.array((F.col("id") % 97).cast("double"), (F.col("id") * 3.0)).alias("ts_seconds"))


def segments_of_video(s, d):
    """Transcript segments laid on the ten videos the comments talk about."""
    return A.segments(s, d).withColumn("video_id", F.col("video_id") % 10)


def speech(s, d):
    return B.speech_rate_curve(A.segments(s, d), audio_durations(s, d))


def energies(s, d):
    return B.energy_curve(A.audio_windows(s, d), audio_durations(s, d))


def shortened(s, d):
    return A.audio_windows(s, d).withColumn("end_time", F.col("start_time") + (F.col("end_time") - F.col("start_time")) / 2)


def asr(s, d):
    x = A.segments(s, d)
    return x.select("video_id", F.col("start_time").alias("start"), F.col("end_time").alias("end"), "text", (F.col("confidence") - 1).alias("avg_log_prob"))


def ocr_tokens(s, d):
    """Words of conversations as readings of two engines."""
    c = A.table(s, d, "conversations")
    w = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("frame_id"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("i", "w"))
    both = F.array(F.struct(F.lit("a").alias("engine"), ((F.col("i") * 7 % 10) / 10).alias("confidence"), F.col("w").alias("text")),
                   F.struct(F.lit("b").alias("engine"), ((F.col("i") * 3 % 10) / 10).alias("confidence"),
                            F.when(F.col("i") % 2 == 0, F.lower("w")).otherwise((F.col("i") * 11).cast("string")).alias("text")))
    return w.select("frame_id", F.explode(both).alias("x")).select("frame_id", "x.*")


def evolution_input(s, d):
    v = A.videos(s, d)
    return v.select("channel_id", "id", F.col("uploaded_at").alias("ts"), (F.col("id") % 13).alias("intro_duration_s"), (100 + F.col("id") % 90).alias("speaking_rate_wpm"),
                    F.when(F.col("id") % 5 != 0, F.col("view_count") % 2500).alias("unique_word_count"), (F.col("id") % 3 == 0).alias("has_sponsor"),
                    (F.col("id") % 25).alias("cut_frequency_per_min"), ((F.col("id") % 10) / 10).alias("mic_quality_score"), "has_captions")


def growth_input(s, d):
    return A.videos(s, d).select("channel_id", F.col("uploaded_at").alias("snapshot_ts"), F.col("view_count").alias("subscriber_count"))


def histograms(s, d):
    """Frames with a small colour histogram."""
    f = A.frames(s, d)
    return f.select("id", "video_id", "timestamp", F.array(*[(F.col("id") * k % 17 + F.lit(1.0)) for k in (1, 3, 5, 7)]).alias("histogram"))


def raw_measures(s, d):
    return A.audio_windows(s, d).select("video_id", F.col("start_time").alias("at"), "music_probability", "loudness_lufs")


def milli(seconds):
    return F.floor(seconds * 1e3 + 0.5).cast("string")


QUERIES = {
    "sliding_windows": lambda s, d: B.sliding_windows(raw_measures(s, d), audio_durations(s, d), ["music_probability", "loudness_lufs"]).select(
        "video_id", "start_time", "end_time", "n", *[F.floor(F.col(f"mean_{c}") * 1e6 + 0.5).alias(f"{c}_micro") for c in ("music_probability", "loudness_lufs")]),
    "link_timestamps": lambda s, d: J.link_timestamps(timed_comments(s, d), segments_of_video(s, d)),
    "overlapping_windows": lambda s, d: J.overlapping(
        A.segments(s, d).select("id", "video_id", "start_time", "end_time"), A.audio_windows(s, d).select("video_id", F.col("id").alias("window_id"), F.col("start_time").alias("w0"), F.col("end_time").alias("w1")),
        "video_id", ("start_time", "end_time"), ("w0", "w1"), 30.0).select("id", "window_id"),
    "nearby_ocr": lambda s, d: J.nearby_ocr(A.segments(s, d), A.frames(s, d)),
    "curve_at": lambda s, d: J.curve_at(energies(s, d), A.segments(s, d).select("video_id", "id", F.col("start_time").alias("at")), 0.5).select(
        "id", "video_id", F.floor(F.col("value") * 1e6 + 0.5).alias("micro")),
    "change_signals": lambda s, d: U.change_signals(A.audio_windows(s, d)).select(
        "id", "video_id", F.size("signals").cast("long").alias("n"), F.array_join(F.transform("signals", lambda x: x["type"]), ",").alias("types")),
    "raw_change_points": lambda s, d: U.raw_change_points(A.audio_windows(s, d)).select("id", "video_id", F.floor(F.col("magnitude") * 1e6 + 0.5).alias("micro"), "transition_type"),
    "suppress_nearby": lambda s, d: U.change_points(A.audio_windows(s, d), 40.0).select("id", "video_id", "timestamp"),
    "change_point_list": lambda s, d: L.change_points_of(U.raw_change_points(A.audio_windows(s, d)), min_magnitude=0.5).select("id", "video_id", "timestamp"),
    "by_transition": lambda s, d: L.by_transition(U.raw_change_points(A.audio_windows(s, d)), "harmonic_shift").select("video_id", "timestamp"),
    "change_point_summary": lambda s, d: G.change_point_summary(U.raw_change_points(A.audio_windows(s, d))).withColumn("dominant_transitions", F.array_join("dominant_transitions", ",")),
    "align": lambda s, d: U.align(A.segments(s, d), A.audio_windows(s, d)).select(
        "id", "quality_level", F.size("warnings").cast("long").alias("warnings"), F.floor(F.col("alignment_score") * 1e4 + 0.500001).alias("score")),
    "alignment_summary": lambda s, d: G.alignment_summary(U.align(A.segments(s, d), A.audio_windows(s, d))).withColumn(
        "mismatch_regions", F.array_join(F.transform("mismatch_regions", lambda x: F.concat_ws("-", milli(x["start_time"]), milli(x["end_time"]))), ",")),
    "mismatch_regions": lambda s, d: G.mismatch_regions(U.align(A.segments(s, d), A.audio_windows(s, d))),
    "upload_cadence": lambda s, d: B.upload_cadence(A.uploads(s, d)).drop("weekday_distribution", "hour_distribution"),
    "upload_cadence_dense": lambda s, d: B.upload_cadence(A.dense_uploads(s, d)).select(
        "channel_id", "median_interval_hours", "periodicity_score", F.col("weekday_distribution")[0].alias("monday"), F.col("weekday_distribution")[6].alias("sunday"),
        F.col("hour_distribution")[0].alias("midnight"), F.col("hour_distribution")[13].alias("one_pm")),
    "break_spikes": lambda s, d: B.break_spikes(A.uploads(s, d)),
    "infer_timezone": lambda s, d: B.infer_timezone(A.dense_uploads(s, d)),
    "speech_rate_curve": lambda s, d: B.speech_rate_curve(A.segments(s, d), text_durations(s, d)).select("video_id", "bucket", F.floor(F.col("value") * 1e6 + 0.5).alias("micro")),
    "energy_curve": lambda s, d: energies(s, d).select("video_id", "bucket", F.floor(F.col("value") * 1e6 + 0.5).alias("micro")),
    "music_density_curve": lambda s, d: B.music_density_curve(A.audio_windows(s, d), audio_durations(s, d)).select("video_id", "bucket", F.floor(F.col("value") * 1e6 + 0.5).alias("micro")),
    "curve_summary": lambda s, d: B.curve_summary(energies(s, d)),
    "window_stats": lambda s, d: B.window_stats(energies(s, d), 60, 600, 0.5).drop("curve_type"),
    "silence": lambda s, d: B.silence(shortened(s, d), audio_durations(s, d), 0.8),
    "derived_metrics": lambda s, d: B.derived_metrics(speech(s, d), energies(s, d)),
    "highlights": lambda s, d: B.highlights(speech(s, d), energies(s, d)).drop("rank"),
    "info_density": lambda s, d: B.info_density(speech(s, d), energies(s, d), audio_durations(s, d)),
    "stale_videos": lambda s, d: B.stale_videos(A.videos(s, d), AS_OF).select("id", "priority_score", "last_crawled_at"),
    "stale_channels": lambda s, d: B.stale_channels(A.channels(s, d), AS_OF).select("id", "priority_tier", "last_crawled_at"),
    "creator_evolution": lambda s, d: B.creator_evolution(evolution_input(s, d)),
    "seasonal": lambda s, d: B.seasonal(A.uploads(s, d)),
    "growth": lambda s, d: B.growth(growth_input(s, d)),
    "scene_pacing": lambda s, d: B.scene_pacing(A.frames(s, d)),
    "drop_hallucinations": lambda s, d: U.drop_hallucinations(A.segments(s, d).withColumn(
        "text", F.when(F.col("id") % 3 == 0, F.concat("text", F.repeat(F.lit(" go"), 12))).otherwise(F.col("text")))).select("id", "video_id"),
    "chunk_transcript": lambda s, d: U.chunk_transcript(asr(s, d)).select("video_id", "start_time", "end_time", "text", "confidence"),
    "scene_changes": lambda s, d: U.scene_changes(histograms(s, d), 0.3).select("id", "is_scene_change", F.floor(F.col("distance") * 1e6 + 0.5).alias("micro")),
    "merge_ocr": lambda s, d: U.merge_ocr(ocr_tokens(s, d)),
    "smooth_ocr": lambda s, d: U.smooth_ocr(A.frames(s, d)).select("id", "ocr_text", F.floor(F.col("ocr_confidence") * 1e6 + 0.5).alias("micro")),
}

MICRO = "CAST(floor({}*1e6+0.5) AS BIGINT)"
LAG = "lag({0}) OVER w AS p_{0}"
SIGNALS = f"""lg AS (SELECT *, {', '.join(LAG.format(c) for c in ('music_probability', 'speech_probability', 'dominant_source', 'loudness_lufs', 'spectral_centroid', 'harmonic_ratio', 'tag'))}
    FROM audio_windows WINDOW w AS (PARTITION BY video_id ORDER BY start_time, id)),
  sg AS (SELECT id, video_id, start_time, greatest(abs(music_probability-p_music_probability), abs(speech_probability-p_speech_probability)) AS sd,
    CASE WHEN dominant_source<>p_dominant_source AND greatest(abs(music_probability-p_music_probability), abs(speech_probability-p_speech_probability))>0.3 THEN
      CASE WHEN p_dominant_source || '_to_' || dominant_source IN ('silence_to_music','music_to_silence','silence_to_speech','speech_to_silence','music_to_speech','speech_to_music')
        THEN p_dominant_source || '_to_' || dominant_source ELSE 'spectral_shift' END ELSE 'unknown' END AS st,
    (pow(10,coalesce(loudness_lufs,-30)/20)+1e-8)/(pow(10,coalesce(p_loudness_lufs,-30)/20)+1e-8) AS up,
    (pow(10,coalesce(p_loudness_lufs,-30)/20)+1e-8)/(pow(10,coalesce(loudness_lufs,-30)/20)+1e-8) AS dn,
    least(1.0, abs(spectral_centroid-p_spectral_centroid)/greatest((spectral_centroid+p_spectral_centroid)/2+1e-8,1.0)*2) AS sp,
    least(1.0, abs(harmonic_ratio-p_harmonic_ratio)*3) AS hs,
    music_probability-CASE WHEN tag=p_tag THEN p_music_probability ELSE 0 END AS od, music_probability AS oc
    FROM lg WHERE p_music_probability IS NOT NULL),
  sl AS (SELECT id, video_id, start_time, list_filter([CASE WHEN sd>0.4 THEN {{'m': sd, 't': st}} END,
    CASE WHEN least(1.0,(greatest(up,dn)-1)/5)>0.3 THEN {{'m': least(1.0,(greatest(up,dn)-1)/5), 't': CASE WHEN up>3 THEN 'energy_spike' WHEN dn>3 THEN 'energy_drop' ELSE 'unknown' END}} END,
    CASE WHEN sp>0.35 THEN {{'m': sp, 't': 'spectral_shift'}} END, CASE WHEN hs>0.3 THEN {{'m': hs, 't': 'harmonic_shift'}} END,
    CASE WHEN od>0.3 AND oc>0.3 AND least(1.0,od*1.5)>0.3 THEN {{'m': least(1.0,od*1.5), 't': 'event_onset'}} END], lambda x: x IS NOT NULL) AS s FROM sg),
  rp AS (SELECT * FROM (SELECT id, video_id, start_time AS timestamp, list_max(list_transform(s, lambda x: x.m)) AS m0, len(s) AS n,
    s[list_position(list_transform(s, lambda x: x.m), list_max(list_transform(s, lambda x: x.m)))].t AS transition_type,
    CASE WHEN len(s)>=3 THEN least(1.0, least(1.0, list_max(list_transform(s, lambda x: x.m))*1.2)*1.15) WHEN len(s)=2 THEN least(1.0, list_max(list_transform(s, lambda x: x.m))*1.2)
      ELSE list_max(list_transform(s, lambda x: x.m)) END AS magnitude FROM sl WHERE len(s)>0) WHERE magnitude>=0.25)"""
# recogniser pieces one by one: a chunk opens at the first piece after a full one
CHUNKS = f"""cp AS (SELECT video_id, start_time AS s, end_time AS e, confidence-1 AS lp, array_to_string(list_filter({raw_words('text')}, lambda w: lower(w) NOT IN {in_list(ASR_FILLERS)}),' ') AS clean,
    row_number() OVER (PARTITION BY video_id ORDER BY start_time, end_time) AS k FROM segments),
  cw AS (SELECT video_id, k, s, e, lp, clean, clean<>'' AS ok, s AS chunk, CASE WHEN clean<>'' AND e-s>=15 THEN NULL ELSE s END AS carry FROM cp WHERE k=1
    UNION ALL SELECT p.video_id, p.k, p.s, p.e, p.lp, p.clean, p.clean<>'', coalesce(carry, p.s), CASE WHEN p.clean<>'' AND p.e-coalesce(carry, p.s)>=15 THEN NULL ELSE coalesce(carry, p.s) END
    FROM cw JOIN cp p ON p.video_id=cw.video_id AND p.k=cw.k+1)"""
SUPPRESS = """o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, id) AS k FROM rp),
  wk AS (SELECT video_id, k, id AS oid, timestamp AS ot, magnitude AS om, CAST(NULL AS BIGINT) AS done FROM o WHERE k=1
    UNION ALL SELECT o.video_id, o.k, CASE WHEN o.timestamp-ot<40 AND NOT o.magnitude>om THEN oid ELSE o.id END, CASE WHEN o.timestamp-ot<40 AND NOT o.magnitude>om THEN ot ELSE o.timestamp END,
      CASE WHEN o.timestamp-ot<40 AND NOT o.magnitude>om THEN om ELSE o.magnitude END, CASE WHEN o.timestamp-ot<40 THEN NULL ELSE oid END
    FROM wk JOIN o ON o.video_id=wk.video_id AND o.k=wk.k+1)"""
DUR = "dur AS (SELECT video_id, max(end_time) AS duration_s FROM audio_windows GROUP BY 1)"
TDUR = "dur AS (SELECT video_id, max(end_time) AS duration_s FROM segments GROUP BY 1)"


def curve(name, width, spans):
    return f"""{name}_g AS (SELECT video_id, unnest(range(0, CAST(greatest(floor(duration_s/{width}),1) AS BIGINT))) AS bucket FROM dur),
  {name} AS (SELECT g.video_id, g.bucket, greatest(0.0::DOUBLE, coalesce(max(v),0)) AS value FROM {name}_g g LEFT JOIN ({spans}) s
    ON s.video_id=g.video_id AND g.bucket BETWEEN floor(s.start_time/{width}) AND floor(s.end_time/{width}) GROUP BY 1,2)"""


SPEECH = curve("sc", 5.0, f"SELECT video_id, start_time, end_time, len({raw_words('text')})/greatest(end_time-start_time,0.1) AS v FROM segments")
ENERGY = curve("ec", 2.0, f"SELECT video_id, start_time, end_time, coalesce({clip('(loudness_lufs+60)/60')}, speech_probability) AS v FROM audio_windows")
MUSIC = curve("mc", 5.0, "SELECT video_id, start_time, end_time, music_probability AS v FROM audio_windows")
ALIGN = f"""hit AS (SELECT s.id, avg(speech_probability) AS sp, count(*) AS n, count(*) FILTER (WHERE speech_probability<0.1 AND music_probability<0.1) AS si
    FROM segments s JOIN audio_windows a ON a.video_id=s.video_id AND a.start_time<s.end_time AND a.end_time>s.start_time GROUP BY 1),
  ab AS (SELECT s.*, coalesce(sp,0) AS sp, coalesce(n,0) AS n, coalesce(si,0)/greatest(coalesce(n,0),1) AS sr, greatest(end_time-start_time,0.1) AS ln, len({raw_words('text')}) AS wc
    FROM segments s LEFT JOIN hit USING (id) WHERE video_id IN (SELECT video_id FROM audio_windows)),
  ac AS (SELECT *, wc/ln AS wps, ln/greatest(wc/2.5,0.1) AS fit FROM ab),
  ad AS (SELECT *, CASE WHEN sp>0.5 THEN CASE WHEN wps<0.5 THEN 0.2 WHEN wps>6 THEN 0.5 ELSE least(1.0,wps/2.5) END WHEN sp<0.2 AND wc>5 THEN 0.3 ELSE 1.0 END AS q1,
    CASE WHEN confidence<0.3 AND sp>0.5 THEN 0.2 WHEN confidence<0.5 THEN confidence*0.8 ELSE confidence END AS q2,
    CASE WHEN wc=0 THEN 1.0 WHEN fit<0.3 THEN 0.3 WHEN fit>5 THEN 0.4 ELSE least(1.0,1-abs(1-fit)*0.3) END AS q3,
    CASE WHEN n=0 THEN 1.0 WHEN sr>0.7 AND wc>3 THEN 0.2 WHEN sr>0.4 AND wc>3 THEN 0.5 ELSE 1-sr*0.3 END AS q4,
    CAST(sp>0.5 AND wps<0.5 AS INT)+CAST(sp>0.5 AND wps>6 AS INT)+CAST(sp<=0.5 AND sp<0.2 AND wc>5 AS INT)+CAST(confidence<0.3 AND sp>0.5 AS INT)
      +CAST(wc>0 AND fit<0.3 AS INT)+CAST(n>0 AND sr>0.7 AND wc>3 AS INT) AS warnings FROM ac),
  al AS (SELECT *, {clip('q1*0.3+q2*0.3+q3*0.2+q4*0.2')} AS score FROM ad),
  aq AS (SELECT *, CASE WHEN score+1e-9>=0.8 THEN 'good' WHEN score+1e-9>=0.55 THEN 'acceptable' WHEN score+1e-9>=0.3 THEN 'poor' ELSE 'mismatch' END AS quality_level FROM al)"""


def cadence(model):
    return f"""g AS (SELECT channel_id, (epoch_us(ts)-epoch_us(lag(ts) OVER w))/1e6/3600 AS gap, row_number() OVER w AS k FROM {model} WINDOW w AS (PARTITION BY channel_id ORDER BY ts, video_id)),
  st AS (SELECT channel_id, avg(gap) AS m, stddev_pop(gap) AS sd, quantile_cont(gap,0.5) AS med, count(gap) AS k FROM g GROUP BY 1),
  z AS (SELECT channel_id, g.k, (gap-m)/greatest(sd,1e-6) AS z FROM g JOIN st USING (channel_id) WHERE gap IS NOT NULL AND st.k>14),
  ac AS (SELECT channel_id, abs(avg(z*z7)) AS acf FROM (SELECT channel_id, z, lead(z,7) OVER (PARTITION BY channel_id ORDER BY k) AS z7 FROM z) GROUP BY 1),
  ct AS (SELECT channel_id, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE isodow(ts)={i + 1}) AS d{i}' for i in (0, 6))}, {', '.join(f'count(*) FILTER (WHERE hour(ts)={h}) AS h{h}' for h in (0, 13))} FROM {model} GROUP BY 1)"""


def interval(c, name):
    return f"{r(f'CASE WHEN n>=3 THEN {c} ELSE 0 END', 4)} AS {name}_interval_hours"


PERIOD = f"{r(f'CASE WHEN n>=3 THEN least(1.0,coalesce(acf,0)) ELSE 0 END', 4)} AS periodicity_score"
TZ = "CASE CAST(o AS INT) WHEN -8 THEN 'PST' WHEN -7 THEN 'MST' WHEN -6 THEN 'CST' WHEN -5 THEN 'EST' WHEN 0 THEN 'UTC' WHEN 1 THEN 'CET' WHEN 2 THEN 'EET' WHEN 3 THEN 'AST' WHEN 8 THEN 'CST_CN' WHEN 9 THEN 'JST' ELSE 'UTC' || CASE WHEN o>=0 THEN '+' ELSE '' END || o END"
SEASON = " ".join(f"LEFT JOIN (SELECT a.channel_id, corr(a.c, b.c) AS r{n} FROM dn a JOIN dn b ON a.channel_id=b.channel_id AND a.day=b.day+{n} GROUP BY 1) USING (channel_id)" for n in (7, 30, 90))


def acf(n):
    return f"CASE WHEN days>={n}+2 AND NOT isnan(r{n}) THEN {r(f'r{n}', 4)} END"


EVO = """ev AS (SELECT channel_id, id, uploaded_at AS ts, id%13 AS a, 100+id%90 AS b, coalesce(CASE WHEN id%5<>0 THEN view_count%2500 END, 500) AS c, CASE WHEN id%3=0 THEN 1 ELSE 0 END AS sp,
   id%25 AS cut, floor((least(1.0,(id%10)/10)*0.25+least(1.0,(id%25)/20)*0.25+CASE WHEN has_captions THEN 1.0 ELSE 0.5 END*0.25
     +least(1.0,coalesce(CASE WHEN id%5<>0 THEN view_count%2500 END,500)/2000)*0.25)*1e3+0.500001)/1e3 AS score,
   row_number() OVER (PARTITION BY channel_id ORDER BY uploaded_at, id)-1 AS pos, count(*) OVER (PARTITION BY channel_id) AS n FROM videos)"""


def slope(c, digits):
    return f"CASE WHEN max(n)<3 THEN 0.0 ELSE coalesce({r(f'regr_slope({c}, pos)', digits)},0) END"


ORACLE = {
    "link_timestamps": sql("comments segments", """SELECT comment_id, video_id, second, arg_min(sid, st*1e9+sid) AS segment_id FROM (SELECT c.id AS comment_id, c.video_id, second, s.id AS sid, s.start_time AS st
        FROM (SELECT id, video_id, unnest([(id%97)::DOUBLE, id*3.0::DOUBLE]) AS second FROM comments) c JOIN segments s ON s.video_id%10=c.video_id AND second>=s.start_time AND second<=s.end_time) GROUP BY 1,2,3""".replace(
            "arg_min(sid, st*1e9+sid)", "(min({'a': st, 'b': sid})).b")),
    "overlapping_windows": sql("segments audio_windows", """SELECT s.id, w.id AS window_id FROM segments s JOIN audio_windows w ON w.video_id=s.video_id
        AND w.start_time<s.end_time AND w.end_time>s.start_time"""),
    "nearby_ocr": sql("segments frames", """SELECT segment_id, array_to_string(list_sort(list_distinct(list(ocr_text))),' ') AS ocr_text FROM (SELECT s.id AS segment_id, ocr_text,
        row_number() OVER (PARTITION BY s.id ORDER BY timestamp, f.id) AS k FROM segments s JOIN frames f ON f.video_id=s.video_id AND abs(f.timestamp-s.start_time)<20) WHERE k<=5 GROUP BY 1"""),
    "curve_at": sql("segments audio_windows", f"""SELECT s.id, s.video_id, {MICRO.format('coalesce(ec.value, m.m)')} AS micro FROM segments s JOIN (SELECT video_id, avg(value) AS m FROM ec GROUP BY 1) m USING (video_id)
        LEFT JOIN ec ON ec.video_id=s.video_id AND ec.bucket=floor(s.start_time*0.5)""", DUR, ENERGY),
    "sliding_windows": sql("audio_windows", f"""SELECT w.video_id, k*2.5::DOUBLE AS start_time, least(k*2.5+5, d)::DOUBLE AS end_time, count(a.id) AS n, {MICRO.format('avg(music_probability)')} AS music_probability_micro,
        {MICRO.format('avg(loudness_lufs)')} AS loudness_lufs_micro FROM (SELECT video_id, d, unnest(range(0, CAST(floor((d-2.5)/2.5) AS BIGINT)+1)) AS k FROM (SELECT video_id, max(end_time) AS d FROM audio_windows GROUP BY 1) WHERE d>=2.5) w
        LEFT JOIN (SELECT *, unnest([CAST(floor(start_time/2.5) AS BIGINT)-1, CAST(floor(start_time/2.5) AS BIGINT)]) AS k FROM audio_windows) a USING (video_id, k) GROUP BY w.video_id, k, d"""),
    "drop_hallucinations": sql("segments", f"""SELECT id, video_id FROM (SELECT *, {LOOPED} AS rep, {words('t')} AS w FROM tx) WHERE NOT (t='' OR rep OR end_time<start_time
        OR (len(w)>5 AND coalesce(list_max(list_transform(list_distinct(w), lambda a: len(list_filter(w, lambda b: b=a)))),0)/len(w)>0.6))""",
        "tx AS (SELECT id, video_id, start_time, end_time, trim(CASE WHEN id%3=0 THEN text || repeat(' go',12) ELSE text END) AS t FROM segments)", LOOPS.format("tx")),
    "chunk_transcript": sql("segments", f"""SELECT video_id, {r('least(chunk, coalesce(greatest(lag(chunk) OVER w, lag(end_time) OVER w-2), chunk))', 2)} AS start_time, {r('end_time', 2)} AS end_time, text, {r('c', 3)} AS confidence FROM (
        SELECT video_id, chunk, CASE WHEN max(e)-chunk<15 THEN any_value(ve) ELSE max(e) END AS end_time, string_agg(clean, ' ' ORDER BY s, e, clean) AS text, avg(greatest(0.0, least(1.0, 1+lp))) AS c
        FROM cw JOIN (SELECT video_id, max(end_time) AS ve FROM segments GROUP BY 1) USING (video_id) WHERE ok GROUP BY video_id, chunk) WINDOW w AS (PARTITION BY video_id ORDER BY chunk)""", CHUNKS),
    "change_signals": sql("audio_windows", "SELECT id, video_id, len(s) AS n, array_to_string(list_transform(s, lambda x: x.t), ',') AS types FROM sl", SIGNALS),
    "raw_change_points": sql("audio_windows", f"SELECT id, video_id, {MICRO.format('magnitude')} AS micro, transition_type FROM rp", SIGNALS),
    "suppress_nearby": sql("audio_windows", """SELECT rp.id, rp.video_id, timestamp FROM rp WHERE rp.id IN (SELECT done FROM wk WHERE done IS NOT NULL
        UNION SELECT oid FROM wk QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY k DESC)=1)""", SIGNALS, SUPPRESS),
    "change_point_list": sql("audio_windows", "SELECT id, video_id, timestamp FROM rp WHERE magnitude>=0.5", SIGNALS),
    "by_transition": sql("audio_windows", "SELECT video_id, timestamp FROM rp WHERE transition_type='harmonic_shift' ORDER BY magnitude DESC, video_id, timestamp LIMIT 50", SIGNALS),
    "change_point_summary": sql("audio_windows", """SELECT video_id, count(*) AS total_change_points, count(*)+1 AS num_scenes, max(timestamp) AS last_timestamp, any_value(d) AS dominant_transitions
        FROM rp JOIN (SELECT video_id, string_agg(transition_type, ',' ORDER BY k) AS d FROM (SELECT video_id, transition_type,
          row_number() OVER (PARTITION BY video_id ORDER BY count(*) DESC, transition_type) AS k FROM rp GROUP BY 1,2) WHERE k<=3 GROUP BY 1) USING (video_id) GROUP BY 1""", SIGNALS),
    "align": sql("segments audio_windows", "SELECT id, quality_level, CAST(warnings AS BIGINT) AS warnings, CAST(floor(score*1e4+0.500001) AS BIGINT) AS score FROM aq", ALIGN),
    "alignment_summary": sql("segments audio_windows", f"""SELECT video_id, count(*) AS segments, {r('avg(score)', 3)} AS overall_score,
        CASE WHEN avg(score)+1e-9>=0.8 THEN 'good' WHEN avg(score)+1e-9>=0.55 THEN 'acceptable' WHEN avg(score)+1e-9>=0.3 THEN 'poor' ELSE 'mismatch' END AS overall_quality,
        CAST(sum(warnings) AS BIGINT) AS total_warnings, count(*) FILTER (WHERE quality_level IN ('poor','mismatch')) AS mismatch_count,
        coalesce(string_agg(CAST(CAST(floor(start_time*1e3+0.5) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(floor(end_time*1e3+0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY start_time, end_time)
          FILTER (WHERE quality_level IN ('poor','mismatch')), '') AS mismatch_regions FROM aq GROUP BY 1""", ALIGN),
    "mismatch_regions": sql("segments audio_windows", "SELECT video_id, start_time, end_time, quality_level FROM aq WHERE quality_level IN ('poor','mismatch')", ALIGN),
    "upload_cadence": sql("uploads", f"""SELECT channel_id, n AS upload_count, {interval('m', 'mean')}, {interval('sd', 'std')}, {interval('med', 'median')}, {PERIOD},
        CASE WHEN k>2 THEN {r('med/24', 4)} END AS dominant_period_days, {r('CASE WHEN n>=3 THEN 1-least(sd/greatest(m,1e-9),2.0)/2 ELSE 0 END', 4)} AS regularity,
        {r('CASE WHEN n>=3 THEN least(0.95,0.3+n*0.02) ELSE 0.1 END', 4)} AS confidence FROM ct LEFT JOIN st USING (channel_id) LEFT JOIN ac USING (channel_id)""", cadence("uploads")),
    "upload_cadence_dense": sql("dense_uploads", f"""SELECT channel_id, {interval('med', 'median')}, {PERIOD}, {r('d0/n', 4)} AS monday, {r('d6/n', 4)} AS sunday,
        {r('h0/n', 4)} AS midnight, {r('h13/n', 4)} AS one_pm FROM ct LEFT JOIN st USING (channel_id) LEFT JOIN ac USING (channel_id)""", cadence("dense_uploads")),
    "break_spikes": sql("uploads", f"""SELECT channel_id, t0 AS break_start, t1 AS break_end, {r('gap', 4)} AS break_duration_days, {r('post/7.0', 4)} AS post_break_upload_rate,
        {r('pre/7.0', 4)} AS pre_break_upload_rate, {r('(post/7.0)/greatest(pre/7.0,0.01)', 4)} AS spike_ratio, {r('least(1.0,(gap-m)/greatest(sd*3,1.0))', 4)} AS anomaly_score FROM (
        SELECT *, (SELECT count(*) FROM uploads u WHERE u.channel_id=g.channel_id AND u.ts BETWEEN t1 AND t1+INTERVAL 7 DAY) AS post,
          (SELECT count(*) FROM uploads u WHERE u.channel_id=g.channel_id AND u.ts BETWEEN t0-INTERVAL 7 DAY AND t0) AS pre FROM g JOIN st USING (channel_id)
        WHERE k>=4 AND gap>m+2*greatest(sd,1.0))""",
        """g AS (SELECT * FROM (SELECT channel_id, lag(ts) OVER w AS t0, ts AS t1, (epoch_us(ts)-epoch_us(lag(ts) OVER w))/1e6/86400 AS gap FROM uploads
          WINDOW w AS (PARTITION BY channel_id ORDER BY ts, video_id)) WHERE t0 IS NOT NULL)""",
        "st AS (SELECT channel_id, avg(gap) AS m, stddev_pop(gap) AS sd, count(*) AS k FROM g GROUP BY 1)"),
    "infer_timezone": sql("dense_uploads", f"""SELECT channel_id, CASE WHEN n>=10 THEN o ELSE 0 END::DOUBLE AS inferred_tz_offset, CASE WHEN n>=10 THEN {TZ} ELSE 'UTC' END AS inferred_tz_name,
        CAST(CASE WHEN n>=10 THEN peak ELSE 12 END AS BIGINT) AS peak_local_hour, {r('CASE WHEN n>=10 THEN least(0.9, ins/n) ELSE 0.1 END', 4)} AS confidence FROM best JOIN pk USING (channel_id)""",
        """tr AS (SELECT channel_id, o, count(*) AS n, count(*) FILTER (WHERE (hour(ts)*60+minute(ts)+o*60+1440)%1440 BETWEEN 480 AND 1200) AS ins FROM dense_uploads
          CROSS JOIN (SELECT unnest(range(-12,13)) AS o) GROUP BY 1,2)""",
        "best AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY ins DESC, o)=1)",
        """pk AS (SELECT channel_id, h AS peak FROM (SELECT channel_id, (hour(ts)+o+24)%24 AS h, count(*) AS c FROM dense_uploads JOIN best USING (channel_id) GROUP BY 1,2)
          QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY c DESC, h)=1)"""),
    "speech_rate_curve": sql("segments", f"SELECT video_id, bucket, {MICRO.format('value')} AS micro FROM sc", TDUR, SPEECH),
    "energy_curve": sql("audio_windows", f"SELECT video_id, bucket, {MICRO.format('value')} AS micro FROM ec", DUR, ENERGY),
    "music_density_curve": sql("audio_windows", f"SELECT video_id, bucket, {MICRO.format('value')} AS micro FROM mc", DUR, MUSIC),
    "curve_summary": sql("audio_windows", f"""SELECT video_id, 'energy' AS curve_type, count(*) AS buckets, {r('min(value)', 4)} AS min_val, {r('max(value)', 4)} AS max_val,
        {r('avg(value)', 4)} AS mean_val, {r('stddev_pop(value)', 4)} AS std_val FROM ec GROUP BY 1""", DUR, ENERGY),
    "window_stats": sql("audio_windows", f"""SELECT video_id, {', '.join(f"coalesce({r(f'{f}(value) FILTER (WHERE bucket>=30 AND bucket<300)', 4)},0) AS {n}" for f, n in (('avg', 'mean'), ('max', 'max'), ('min', 'min'), ('stddev_pop', 'std')))}
        FROM ec GROUP BY 1""", DUR, ENERGY),
    "silence": sql("audio_windows", f"""SELECT video_id, {r('coalesce(sum(gap),0)', 3)} AS total_silence_seconds, {r('coalesce(sum(gap),0)/greatest(any_value(duration_s),1)', 4)} AS silence_ratio,
        {r('coalesce(avg(gap),0)', 3)} AS mean_gap_duration, {r('coalesce(max(gap),0)', 3)} AS max_gap_duration, count(gap) AS gap_count,
        count(*) FILTER (WHERE gap BETWEEN 0.8 AND 3.5) AS dramatic_pause_count FROM (SELECT video_id, CASE WHEN start_time>seen+0.5 AND sp<0.8 THEN start_time-seen END AS gap FROM (
          SELECT video_id, start_time, speech_probability AS sp, greatest(0.0::DOUBLE, coalesce(max(start_time+(end_time-start_time)/2) OVER (PARTITION BY video_id ORDER BY start_time, id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)) AS seen FROM audio_windows)) JOIN dur USING (video_id) GROUP BY 1""", DUR),
    "derived_metrics": sql("segments audio_windows", f"""SELECT video_id, {r(f"CASE WHEN n>4 THEN {clip('(q4-q1)/greatest(q1,0.01)*0.5+0.5')} ELSE 0.5 END", 3)} AS excitement_ramp_score,
        {r(f"CASE WHEN sn>4 THEN {clip('(h1-h2)/greatest(h1,0.01)')} ELSE 0.3 END", 3)} AS attention_decay_probability,
        {r(f"CASE WHEN es>1e-9 THEN {clip('1-abs(es/greatest(em,0.01)-0.4)*2')} ELSE 0.3 END", 3)} AS pacing_quality_score, {r('least(0.85,0.4+n*0.001)', 3)} AS confidence
        FROM (SELECT video_id, max(n) AS n, avg(value) AS em, stddev_pop(value) AS es, avg(value) FILTER (WHERE bucket<n//4) AS q1, avg(value) FILTER (WHERE bucket>=3*n//4) AS q4
          FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM ec) GROUP BY 1) JOIN (SELECT video_id, max(n) AS sn, avg(value) FILTER (WHERE bucket<n//2) AS h1,
          avg(value) FILTER (WHERE bucket>=n//2) AS h2 FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM sc) GROUP BY 1) USING (video_id)""", DUR, SPEECH, ENERGY),
    "highlights": sql("segments audio_windows", f"""SELECT video_id, {r('bucket/0.5', 3)} AS timestamp, {r('least(1.0,(v-t)/greatest(t,0.01))', 3)} AS probability FROM cb
        JOIN (SELECT video_id, quantile_cont(v,0.85) AS t FROM cb GROUP BY 1) USING (video_id) WHERE v>t+1e-9 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY bucket)<=20""",
        DUR, SPEECH, ENERGY, f"""cb AS (SELECT e.video_id, e.bucket, {r('e.value+s.value', 9)} AS v FROM ec e JOIN sc s USING (video_id, bucket)
          WHERE e.video_id IN (SELECT video_id FROM ec GROUP BY 1 HAVING count(*)>10))"""),
    "info_density": sql("segments audio_windows", f"""SELECT g.video_id, g.minute, {r('coalesce(s,0)*30+coalesce(e,0)*20', 1)} AS density FROM (SELECT video_id,
        unnest(range(0, CAST(greatest(floor(duration_s/60),1) AS BIGINT))) AS minute FROM dur) g
        LEFT JOIN (SELECT video_id, bucket//12 AS minute, avg(value) AS s FROM sc GROUP BY 1,2) USING (video_id, minute)
        LEFT JOIN (SELECT video_id, bucket//30 AS minute, avg(value) AS e FROM ec GROUP BY 1,2) USING (video_id, minute)""", DUR, SPEECH, ENERGY),
    "stale_videos": sql("videos", f"SELECT id, priority_score, last_crawled_at FROM videos WHERE status='indexed' AND last_crawled_at<TIMESTAMP '{AS_OF}'-INTERVAL 168 HOUR ORDER BY priority_score DESC, id LIMIT 20"),
    "stale_channels": sql("channels", f"SELECT id, priority_tier, last_crawled_at FROM channels WHERE is_active AND last_crawled_at<TIMESTAMP '{AS_OF}'-INTERVAL 336 HOUR ORDER BY priority_tier DESC, id LIMIT 20"),
    "creator_evolution": sql("videos", f"""SELECT channel_id, max(n) AS video_count, CASE WHEN max(n)>=3 THEN min(ts) END AS first_video, CASE WHEN max(n)>=3 THEN max(ts) END AS latest_video,
        {slope('a', 4)} AS intro_length_drift, {slope('b', 4)} AS speech_speed_drift, {slope('c', 2)} AS vocabulary_growth_rate, {slope('sp', 4)} AS sponsor_density_trend,
        {slope('cut', 4)} AS editing_complexity_trend, CASE WHEN max(n)>=3 THEN {r('avg(score) FILTER (WHERE pos<greatest(n//3,1))', 3)} END AS early,
        CASE WHEN max(n)>=3 THEN {r('avg(score) FILTER (WHERE pos>=greatest(n//3,1) AND pos<2*greatest(n//3,1))', 3)} END AS mid,
        CASE WHEN max(n)>=3 THEN {r('avg(score) FILTER (WHERE pos>=2*greatest(n//3,1))', 3)} END AS recent,
        {r('CASE WHEN max(n)<3 THEN 0.1 ELSE least(0.85,0.3+max(n)*0.01) END', 3)} AS confidence FROM ev GROUP BY 1""", EVO),
    "seasonal": sql("uploads", f"""SELECT channel_id, {', '.join(f'{acf(n)} AS acf_{n}' for n in (7, 30, 90))}, greatest(0.0::DOUBLE, {', '.join(f'coalesce({acf(n)},0)' for n in (7, 30, 90))}) AS strength,
        wd AS peak_weekday, hr AS peak_hour FROM (SELECT channel_id, count(*) AS days FROM dn GROUP BY 1) {SEASON}
        JOIN (SELECT channel_id, wd FROM (SELECT channel_id, isodow(ts)-1 AS wd, count(*) AS c FROM uploads GROUP BY 1,2) QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY c DESC, wd)=1) USING (channel_id)
        JOIN (SELECT channel_id, hr FROM (SELECT channel_id, hour(ts) AS hr, count(*) AS c FROM uploads GROUP BY 1,2) QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY c DESC, hr)=1) USING (channel_id)""",
        "dy AS (SELECT channel_id, CAST(ts AS DATE) AS day, count(*) AS c FROM uploads GROUP BY 1,2)",
        """dn AS (SELECT channel_id, day, coalesce(c,0)::DOUBLE AS c FROM (SELECT channel_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT channel_id, min(day) AS a, max(day) AS b FROM dy GROUP BY 1))
          LEFT JOIN dy USING (channel_id, day))"""),
    "growth": sql("videos", f"""SELECT channel_id, latest, {r('r30', 4)} AS growth_30d, {r('r90', 4)} AS growth_90d, {r('r30-r90/3', 4)} AS acceleration, sign(r30)<>sign(r90) AS inflection,
        {r('latest*(1+r30)', 2)} AS projected FROM (SELECT channel_id, latest, CASE WHEN v30<>0 THEN (latest-v30)/v30 END AS r30, CASE WHEN v90<>0 THEN (latest-v90)/v90 END AS r90 FROM (
          SELECT channel_id, any_value(latest) AS latest, (max({{'t': uploaded_at, 'v': v}}) FILTER (WHERE uploaded_at<=t-INTERVAL 30 DAY)).v AS v30,
            (max({{'t': uploaded_at, 'v': v}}) FILTER (WHERE uploaded_at<=t-INTERVAL 90 DAY)).v AS v90
          FROM (SELECT channel_id, uploaded_at, view_count::DOUBLE AS v FROM videos) JOIN (SELECT channel_id, max(uploaded_at) AS t, (max({{'t': uploaded_at, 'v': view_count::DOUBLE}})).v AS latest
            FROM videos GROUP BY 1) USING (channel_id) GROUP BY 1))"""),
    "scene_pacing": sql("frames", f"""SELECT video_id, count(*) AS scenes, {r('avg(dur)', 3)} AS mean_duration, {r('stddev_pop(dur)', 3)} AS std_duration, {r('regr_slope(dur,pos)', 4)} AS trend,
        {r('greatest(0.0,1-stddev_pop(dur)/greatest(avg(dur),1e-9))', 4)} AS regularity FROM (SELECT video_id, timestamp-lag(timestamp) OVER w AS dur, row_number() OVER w-2 AS pos FROM frames
          WHERE is_scene_change WINDOW w AS (PARTITION BY video_id ORDER BY timestamp, id)) WHERE dur IS NOT NULL GROUP BY 1"""),
    "merge_ocr": sql("", f"""SELECT frame_id, string_agg(text, ' ' ORDER BY conf DESC, tok) AS text, {r("avg(least(1.0, conf*CASE WHEN eng>1 THEN 1.2 ELSE 1.0 END*CASE WHEN regexp_matches(text,'^[0-9][0-9,.:]*[0-9]?$') THEN 1.1 ELSE 1.0 END))", 4)} AS confidence FROM (
        SELECT frame_id, lower(text) AS tok, (max({{'c': confidence, 't': text}})).t AS text, max(confidence) AS conf, count(DISTINCT engine) AS eng FROM (
          SELECT frame_id, unnest([{{'engine': 'a', 'confidence': (i*7%10)/10, 'text': w}}, {{'engine': 'b', 'confidence': (i*3%10)/10, 'text': CASE WHEN i%2=0 THEN lower(w) ELSE CAST(i*11 AS VARCHAR) END}}], recursive := true)
          FROM (SELECT conv_id*100+turn AS frame_id, unnest({raw_words('text')}) AS w, generate_subscripts({raw_words('text')},1)-1 AS i FROM conversations)) GROUP BY 1,2) GROUP BY 1"""),
    "smooth_ocr": sql("frames", f"""SELECT id, CASE WHEN single OR len(kept)=0 THEN ocr_text ELSE array_to_string(kept,' ') END AS ocr_text,
        {MICRO.format("CASE WHEN single THEN ocr_confidence WHEN len(kept)>0 THEN CASE WHEN ocr_confidence IS NOT NULL THEN least(1.0,ocr_confidence*1.1) ELSE 1.0 END ELSE ocr_confidence*0.75 END")} AS micro FROM (
        SELECT id, ocr_text, ocr_confidence, a IS NULL AND b IS NULL AS single, list_filter(string_split(ocr_text,' '), lambda t: list_contains(list_concat(string_split(lower(coalesce(a,'')),' '),
          string_split(lower(coalesce(b,'')),' ')), lower(t)) OR regexp_matches(t,'^[0-9]')) AS kept FROM (SELECT id, ocr_text, ocr_confidence, lag(ocr_text) OVER w AS a, lead(ocr_text) OVER w AS b
          FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY timestamp, id)))"""),
    "scene_changes": sql("frames", f"""SELECT id, coalesce(d>0.3, false) AS is_scene_change, {MICRO.format('d')} AS micro FROM (SELECT id, list_sum(list_transform(range(1,5), lambda i: (p[i]-h[i])*(p[i]-h[i])/p[i])) AS d FROM (
        SELECT id, h, lag(h) OVER (PARTITION BY video_id ORDER BY timestamp, id) AS p FROM (SELECT id, video_id, timestamp, list_transform(hh, lambda x: x/sqrt(list_sum(list_transform(hh, lambda y: y*y)))) AS h FROM (
          SELECT id, video_id, timestamp, [(id%17+1)::DOUBLE, (id*3%17+1)::DOUBLE, (id*5%17+1)::DOUBLE, (id*7%17+1)::DOUBLE] AS hh FROM frames))))"""),
}
