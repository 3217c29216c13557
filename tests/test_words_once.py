"""Word counting: the counts of a video's words are made for their two uses only, and no words travel with the order of segments."""
import re

from reeltide.functions import text as T
from reeltide.plans import catalog

SF = "/root/testdata/sf0.001"


def test_linguistic_profile_counts_words_twice_at_most(spark):
    plan = catalog.queries()["linguistic_profile"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    exploded = [x for x in plan.split("\n") if re.search(r"Generate explode\((?!sequence)", x)]
    assert len([x for x in exploded if "posexplode" not in x]) <= 2
    assert not any(re.search(r"\bw#", x) for x in plan.split("\n") if "Window" in x)


def test_words_at_the_borders(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), (" Ab\t c  ",), ("x",)], "t string").select(T.words("t").alias("w"))
    assert [r["w"] for r in df.collect()] == [[], [], [], ["ab", "c"], ["x"]]
