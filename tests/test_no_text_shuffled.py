"""Alignment counts the words where the segments are read; no text goes through its joins."""
from oracle_check import TESTDATA

import __spark_entry__ as entry

SF = f"{TESTDATA}/sf0.001"


def test_align_shuffles_no_text(spark):
    for name in ("align", "alignment_summary", "mismatch_regions"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join LeftSemi" in plan and " AS text#" not in plan, name
