"""A traversal merges what it reaches, not all edges of the graph."""
from reeltide.operators import graph


def test_only_reached_nodes_are_merged(spark, monkeypatch):
    cut, merged = graph.cut_lineage, []

    def watched(df):
        merged.append(df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ["))
        return cut(df)

    monkeypatch.setattr(graph, "cut_lineage", watched)
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("d", "c")], "source string, target string")
    start = spark.createDataFrame([("a",)], "id string")
    got = sorted((r["id"], r["distance"]) for r in graph.traverse(e, start, 3, "both").collect())
    assert got == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert merged == [0, 1, 1, 1]
