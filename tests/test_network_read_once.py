"""The edges of an entity network are worked out once, whatever the depth."""
from reeltide.operators import graph


def test_edges_are_worked_out_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    rows = [("5", "6", "CO_OCCURS_WITH", 1.0), ("6", "7", "CO_OCCURS_WITH", 2.0), ("7", "8", "CO_OCCURS_WITH", 1.0), ("5", "9", "OTHER", 1.0)]
    e = spark.createDataFrame(rows, "source string, target string, edge_type string, weight double")
    members, inside = graph.entity_network(e.mapInArrow(counted, e.schema), "5", 2)
    assert sorted(r["id"] for r in members.collect()) == ["6", "7"]
    assert sorted((r["source"], r["target"]) for r in inside.collect()) == [("5", "6"), ("6", "7")]
    assert calls.value == len(rows)
