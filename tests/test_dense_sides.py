"""Sides that were exploded are larger than the optimizer takes them for, so none may be broadcast."""
import re

import pytest

from reeltide.plans import catalog

SF = "/root/testdata/sf0.001"


def broadcast_dense(plan):
    """What a broadcast holds that is exploded, or grouped by the exploded column."""
    lines = plan.split("\n")
    depth = [len(re.match(r"[\s:+\-|]*", x).group()) for x in lines]
    for i, x in enumerate(lines):
        below = lines[i + 1:next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))] if "BroadcastExchange" in x else []
        first = next((y for y in below if "HashAggregate" in y or "Generate explode(sequence" in y), "")
        if "Generate" in first or re.search(r"keys=\[[^\]]*(bucket|minute|day|_group|k)#", first) and any("Generate explode(sequence" in y for y in below):
            yield first


@pytest.mark.parametrize("name", ["energy_curve", "speech_rate_curve", "music_density_curve", "curve_summary", "window_stats", "curve_at", "derived_metrics", "info_density", "sliding_windows", "seasonal"])
def test_no_exploded_side_is_broadcast(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not list(broadcast_dense(plan))


def test_seasonal_has_no_row_for_a_day_without_uploads(spark):
    plan = catalog.queries()["seasonal"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "sequence(d0" not in plan
