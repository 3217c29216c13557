"""Readers on files, streams replayed from several files, and plan checks."""
import json
import time

import pytest
from pyspark.sql import functions as F

from reeltide.plans import catalog
from reeltide.sources import adapters as A
from reeltide.sources import readers as R
from reeltide.streaming import streams as X

SF = "/root/testdata/sf0.001"


def test_subtitles_prefer_manual(spark, tmp_path):
    (tmp_path / "v1.en.auto.srt").write_text("1\n\n2")
    (tmp_path / "v1.en.vtt").write_text("a\n\nb\n\nc")
    (tmp_path / "v1.de.auto.ass").write_text("x")
    got = {(r["language"], r["format"], r["is_auto_generated"], r["cue_count"]) for r in R.read_subtitles(spark, str(tmp_path)).collect()}
    assert got == {("en", "vtt", False, 2), ("de", "ass", True, 1)}


def test_calibration_samples(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"a.b": [{"raw": 0.5, "truth": 1}, {"raw": 0.25, "truth": 0}], "c": []}))
    assert {tuple(r) for r in R.read_calibration_samples(spark, str(tmp_path)).collect()} == {("a.b", 0.5, 1), ("a.b", 0.25, 0)}


def test_rules(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("weights:\n  text_semantic: 0.25\n")
    assert R.read_rules(str(tmp_path / "r.yaml")) == {"weights": {"text_semantic": 0.25}}


def test_video_info_overflow_and_live(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"id": "x", "webpage_url": "https://www.youtube.com/shorts/x", "is_live": True, "fps": 30, "secret": 1, "upload_date": "20240102", "subtitles": {"en": []},
                                                 "chapters": [{"title": "A", "start_time": 0, "end_time": 9}]}))
    v, c = R.read_video_info(spark, str(tmp_path))
    r = v.first()
    assert (r["platform_id"], r["live_status"], r["is_short"], r["has_captions"]) == ("youtube:x", "is_live", True, True)
    assert r["metadata"] == {"webpage_url": "https://www.youtube.com/shorts/x", "fps": "30"}
    assert c.first()["end_time"] == 9.0


def staged(spark, tmp_path, name, rows, schema):
    """One file per list of rows, in order of their modification times."""
    for part in rows:
        time.sleep(1.1)
        df = spark.createDataFrame(part, schema).coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def test_late_rows_are_dropped(spark, tmp_path):
    import datetime as dt
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    s = staged(spark, tmp_path, "e", [[(t(0), "x"), (t(1), "x")], [(t(60), "x")], [(t(61), "x")], [(t(0), "late"), (t(59), "x")], [(t(200), "end")]], "ts timestamp, event_type string")
    X.append_to(X.event_rate(s), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.filter("event_type = 'late'").count() == 0
    assert got.agg(F.sum("n")).first()[0] == 5
    assert got.groupBy("window_start", "event_type").count().filter("count > 1").isEmpty()


def test_running_state_over_many_batches_equals_batch(spark, tmp_path):
    c = A.comments(spark, SF).select("id", "author_id", "timestamp_posted")
    c.repartition(5).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    X.upsert_to(X.author_state(s), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    got = X.latest_state(spark, str(tmp_path / "o"), ["author_id"]).select("author_id", "comment_count").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in c.groupBy("author_id").count().collect()}


def test_replay_rejects_unknown_types(spark):
    with pytest.raises(ValueError):
        X.replay(spark.range(1), types=["NOPE"])


@pytest.mark.parametrize("name", ["debate_chains", "upload_cadence", "break_spikes", "align", "energy_curve", "audience_overlap", "co_occurrence", "community_metrics", "linguistic_style", "meta_quality",
                                  "sentiment_cascades", "link_timestamps", "reuse", "entity_propagation", "commenter_migration", "video_authenticity", "semantic_intent"])
def test_plans_have_no_cross_join_and_no_python(spark, name):
    df = catalog.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "MapInPandas" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    df = catalog.queries()["chart_data"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "In(event_type" in plan
    assert "props" not in plan.split("ReadSchema")[1]


def test_hot_key_top_n_is_cut_before_the_shuffle(spark):
    plan = catalog.queries()["most_branched"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
