"""PageRank's rounds carry numbers, and count parallel edges, loops and ends that are no nodes as before."""
import pytest

from reeltide.operators import graph

EDGES = [("a", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("d", "a"), ("a", "out"), ("out", "b"), ("e", None), (None, "a")]
NODES = "abcde"


def _plain(directed, rounds=10, damping=0.85):
    edges = [(s, t) for s, t in EDGES if s and t]
    out = {s: sum(x == s for x, _ in edges) for s, _ in edges}
    flow = [(t, s) for s, t in edges] + ([] if directed else edges)
    rank = {n: 1 / len(NODES) for n in NODES}
    for _ in range(rounds):
        rank = {n: (1 - damping) / len(NODES) + damping * sum(rank[w] / out.get(w, 1) for u, w in flow if u == n and w in rank) for n in NODES}
    return {n: r / max(rank.values()) for n, r in rank.items()}


@pytest.mark.parametrize("directed", [False, True])
def test_ranks_of_odd_edges(spark, monkeypatch, directed):
    cut, shapes = graph.cut_lineage, []

    def watched(df):
        shapes.append(dict(df.dtypes))
        return cut(df)

    monkeypatch.setattr(graph, "cut_lineage", watched)
    e = spark.createDataFrame(EDGES, "source string, target string")
    got = {r["id"]: r["influence_centrality"] for r in graph.pagerank(spark.createDataFrame([(x,) for x in NODES + "a"], "id string"), e, directed=directed).collect()}
    assert got == pytest.approx(_plain(directed), abs=6e-5)
    assert [s["u"] for s in shapes if "f" in s] == ["bigint"]
