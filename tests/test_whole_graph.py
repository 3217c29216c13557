"""Communities over every edge of the graph."""
from oracle_check import TESTDATA

import __spark_entry__ as entry
from reeltide.plans import catalog_graph

SF = f"{TESTDATA}/sf0.001"
QUERIES = entry.queries()


def test_communities_of_the_whole_graph(spark):
    """Union-find over every edge."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    edges = [(r["source"], r["target"]) for r in catalog_graph.graph_edges(spark, SF).collect()]
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["community_id"] for r in QUERIES["communities"](spark, SF).collect()}
    assert len(edges) > 3000 and got == {x: find(x) for x in list(parent)}
