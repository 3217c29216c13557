"""What meets in a join is bounded: equal moments and intervals once, no list of neighbours with every edge."""
from reeltide.operators import joins as J
from reeltide.plans import catalog

SF = "/root/testdata/sf0.001"


def test_equal_moments_and_intervals_meet_once(spark, monkeypatch):
    c = spark.range(200).selectExpr("id", "1L AS video_id", "array(7.0D, 7.0D, 90.0D) AS ts_seconds")
    s = spark.range(300).selectExpr("1L AS video_id", "1000 - id AS id", "5.0D AS start_time", "10.0D AS end_time")
    met, real = [], J.points_in_intervals
    monkeypatch.setattr(J, "points_in_intervals", lambda *a: met.append(real(*a)) or met[-1])
    got = {tuple(r) for r in J.link_timestamps(c, s).collect()}
    assert got == {(i, 1, 7.0, 701) for i in range(200)}
    assert met[0].count() == 1


def test_no_list_of_neighbours_travels_with_an_edge(spark):
    plan = catalog.queries()["clustering_betweenness"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "map_from_entries" not in plan and "collect_list" not in plan
