"""Trigrams of a video: those over the borders of segments and time buckets count, and only border words are put in order."""
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from oracle_check import TESTDATA
from reeltide.operators import profiles as P
from reeltide.plans import catalog


def test_trigrams_equal_those_of_the_whole_text(spark):
    draw = random.Random(5)
    rows, texts = [], {}
    for video in range(6):
        texts[video] = []
        for i in range(80):
            w = [draw.choice("abc") for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 7]))]
            rows.append((video, i, draw.choice([0.0, 3.0]) + i // 3 * 9.0, w))
        for r in sorted((r for r in rows if r[0] == video), key=lambda r: (r[2], r[1])):
            texts[video] += r[3]
    df = spark.createDataFrame(rows, "video_id long, id long, start_time double, w array<string>").repartition(5)
    want = Counter((v, *t[i:i + 3]) for v, t in texts.items() for i in range(len(t) - 2))
    names = spark.createDataFrame(sorted({k[1:] for k in want}), "x string, y string, z string").withColumn("g", F.xxhash64("x", "y", "z"))
    for bucket in (5.0, 20.0, 600.0):
        found = P.trigrams(df, bucket).join(names, "g").groupBy("video_id", "x", "y", "z").count().collect()
        assert {tuple(r)[:4]: r["count"] for r in found} == want


def test_no_whole_segments_are_ordered(spark):
    for name in ("meta_quality", "full_report"):
        plan = catalog.queries()[name](spark, f"{TESTDATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert not any(re.search(r"\bw#", x) for x in plan.split("\n") if "Window" in x or "Join" in x), name
        # no function of a text is worked out anew for every word
        assert len(re.findall(r"split\(lower\(", plan)) == len(re.findall(r"explode\(array\(array_remove\(split\(lower\(", plan)) > 0, name
