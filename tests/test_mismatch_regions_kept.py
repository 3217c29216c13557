"""The summary of a video holds its mismatch regions themselves, not only how many there are."""
from reeltide.operators.aggregates import alignment_summary


def test_regions_in_order_of_time(spark):
    rows = [(1, 10.0, 15.0, 0.4, "poor", ["w"]), (1, 0.0, 5.0, 0.1, "mismatch", []), (1, 5.0, 10.0, 0.9, "good", []), (2, 0.0, 5.0, 0.9, "good", [])]
    df = spark.createDataFrame(rows, "video_id long, start_time double, end_time double, alignment_score double, quality_level string, warnings array<string>")
    got = {r["video_id"]: r for r in alignment_summary(df).collect()}
    assert [tuple(x) for x in got[1]["mismatch_regions"]] == [(0.0, 5.0), (10.0, 15.0)]
    assert (got[1]["mismatch_count"], got[1]["overall_quality"], got[1]["total_warnings"]) == (2, "poor", 1)
    assert got[2]["mismatch_regions"] == []
