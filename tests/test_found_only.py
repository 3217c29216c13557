"""Search looks entities up for found pairs of query and video only."""
from reeltide.operators import search as S


def test_entities_meet_entries_before_names(spark):
    entries = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "query_id long, video_id long")
    asked = spark.createDataFrame([(q, n) for q in (1, 2) for n in "abcd"], "query_id long, entity string")
    mentioned = spark.createDataFrame([(v, n) for v in range(300) for n in "ab"] + [(2, "c"), (2, "c"), (9, "d")], "video_id long, entity string")
    out = S.add_entity_overlap(entries, asked, mentioned)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 0.5), (1, 2, 0.75), (2, 3, 0.5)]
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("Join Inner, (entity#" in x and "video_id#" not in x for x in plan)
