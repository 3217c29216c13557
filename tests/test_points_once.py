"""The walk over change points works them out once: what it keeps is looked up in what was stored."""
from oracle_check import TESTDATA
from reeltide.plans import catalog


def test_suppress_nearby_reads_its_windows_once(spark):
    plan = catalog.queries()["suppress_nearby"](spark, f"{TESTDATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "Relation" not in plan
