"""Upload hours exactly at the limit and gaps of exactly one day."""
import datetime

from reeltide.operators.signals import upload_patterns

ZERO = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def test_hour_at_two_deviations_is_not_beyond_them(spark):
    # four equal hours and another one: that one is exactly two deviations from the mean
    rows = [(a * 24 + b, i, ZERO + datetime.timedelta(days=i, hours=a if i < 4 else b)) for a in range(24) for b in range(24) if a != b for i in range(5)]
    got = upload_patterns(spark.createDataFrame(rows, "channel_id long, video_id long, ts timestamp")).collect()
    assert {abs(r["hour_z"]) for r in got} == {0.5, 2.0}
    assert not [r for r in got if r["is_anomalous"]]


def test_whole_day_between_uploads(spark):
    # seconds as a fraction lose digits at 2^30, so their difference is a little less than a day
    first = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(microseconds=1073698624000002)
    rows = [(1, 1, first), (1, 2, first + datetime.timedelta(days=1))]
    got = upload_patterns(spark.createDataFrame(rows, "channel_id long, video_id long, ts timestamp")).orderBy("video_id").collect()
    assert [r["days_since_last"] for r in got] == [None, 1]
