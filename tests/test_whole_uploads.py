"""Topic gestation over every mention line: the first upload is the second distinct time of an entity in a channel."""
from collections import defaultdict

from oracle_check import TESTDATA

import __spark_entry__ as entry
from reeltide.sources import adapters as A


def test_first_upload_of_any_line(spark):
    times = defaultdict(set)
    for r in A.mentions(spark, f"{TESTDATA}/sf0.001").select("channel_id", "entity_id", "ts").collect():
        times[r["channel_id"], r["entity_id"]].add(r["ts"])
    want = {k: tuple(sorted(v)[:2]) for k, v in times.items() if len(v) > 1}
    got = {(r["channel_id"], r["entity_id"]): (r["first_comment_at"], r["first_video_at"]) for r in entry.queries()["topic_gestation"](spark, f"{TESTDATA}/sf0.001").collect()}
    assert got == want
