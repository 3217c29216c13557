"""PageRank over packed parts, and what a run leaves in the checkpoint folder."""
import glob
import os
import random

import pytest

from reeltide.operators import graph


def folders(spark):
    return {f for f in glob.glob(spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/rdd-*") if os.path.isdir(f)}


def some(spark, n=30, m=150):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n) if i % 3 else 0}") for i in range(m)]  # n0 is a hub
    return spark.createDataFrame([(f"n{i}",) for i in range(n)], "id string"), spark.createDataFrame(pairs, "source string, target string"), pairs


def plain_ranks(n, pairs, directed):
    out = {f"n{i}": max(sum(s == f"n{i}" for s, _ in pairs), 1) for i in range(n)}
    flow = [(t, s) for s, t in pairs] + ([] if directed else pairs)
    rank = {x: 1 / n for x in out}
    for _ in range(10):
        rank = {x: 0.15 / n + 0.85 * sum(rank[w] / out[w] for u, w in flow if u == x) for x in out}
    return {x: r / max(rank.values()) for x, r in rank.items()}


@pytest.mark.parametrize("directed", [False, True])
def test_ranks_and_what_is_left(spark, directed):
    nodes, edges, pairs = some(spark)
    graph.cut_lineage(nodes)
    before = folders(spark)
    got = graph.pagerank(nodes, edges, directed=directed)
    assert len(folders(spark) - before) <= 2  # the ranks and the names, no round and no edges
    assert {r["id"]: r["influence_centrality"] for r in got.collect()} == pytest.approx(plain_ranks(30, pairs, directed), abs=6e-5)


def test_triangles_in_passes(spark, monkeypatch):
    nodes, edges, pairs = some(spark, 12, 90)
    kept, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "PASS_EDGES", 20, raising=False)
    monkeypatch.setattr(graph, "cut_lineage", lambda df: kept.append(dict(df.dtypes)) or cut(df))
    before = folders(spark)
    got = {r["id"]: r["clustering"] for r in graph.clustering_betweenness(nodes, edges).collect()}
    near = {}
    for s, t in pairs:
        near.setdefault(s, []).append(t)
        near.setdefault(t, []).append(s)
    inside = {v: sum(near[w].count(x) for w in set(near[v]) for x in set(near[v]) if x in near[w]) for v in near}
    assert got == pytest.approx({v: inside[v] / max(len(near[v]) * (len(near[v]) - 1), 1) for v in near}, abs=6e-5)
    assert [x["u"] for x in kept if "w" in x] == ["bigint"]  # no names beside the counted edges
    assert len(folders(spark) - before) <= 20


def test_measures_of_one_count(spark):
    nodes, edges, _ = some(spark)
    nodes = nodes.selectExpr("id", "'Topic' as node_type")
    want = {r["id"]: (r["influence_centrality"], r["betweenness_centrality"]) for r in graph.pagerank(nodes, edges).join(graph.clustering_betweenness(nodes, edges), "id").collect()}
    before = folders(spark)
    got = graph.graph_intelligence(nodes, edges)
    assert len(folders(spark) - before) <= 6  # names, ranks, clustering and the shares of two sides
    assert {r["id"]: (r["influence_centrality"], r["betweenness_centrality"]) for r in got.collect()} == want
