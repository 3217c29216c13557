"""Components are contracted over numbers, not names."""
from reeltide.operators import graph


def test_communities_carry_numbers(spark, monkeypatch):
    kinds, contract = [], graph.connected_components

    def watched(ends):
        kinds.extend(t for _, t in ends.dtypes)
        return contract(ends)

    monkeypatch.setattr(graph, "connected_components", watched)
    e = spark.createDataFrame([("b", "c"), ("c", "a"), ("a", "b"), ("z", "z"), ("y", None), (None, "x"), ("q", "p"), ("q", "p")], "source string, target string")
    nodes = spark.createDataFrame([("lone",), ("a",), ("lone",)], "id string")
    got = sorted((r["id"], r["community_id"]) for r in graph.communities(e, nodes).collect())
    assert got == [("a", "a"), ("b", "a"), ("c", "a"), ("lone", "lone"), ("p", "p"), ("q", "p"), ("x", "x"), ("y", "y"), ("z", "z")]
    assert kinds == ["bigint", "bigint"]
