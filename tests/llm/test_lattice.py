"""Near vectors against all pairs."""
import itertools

import numpy as np
from conftest import SF
from oracle_check import compare

from reeltide.llm import lattice


def brute(x, threshold=0.9):
    """(links, smallest reachable) by all pairs."""
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    close = unit @ unit.T >= threshold
    np.fill_diagonal(close, False)
    label = np.arange(len(x))
    while True:
        least = np.minimum(label, np.where(close, label[None, :], len(x)).min(1))
        if (least == label).all():
            return close.sum(1), label
        label = least


def partner(rng, x, cosine):
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    return cosine * x + np.sqrt(1 - cosine ** 2) * z / np.linalg.norm(z, axis=1)[:, None]


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_roots_and_decoding():
    assert lattice.ROOTS.shape == (240, 8) and np.allclose((lattice.ROOTS ** 2).sum(1), 2)
    rng = np.random.default_rng(1)
    y = rng.normal(size=(50, 8)) * 1.5
    point = lattice.nearest(y)
    whole = np.array(list(itertools.product((-1, 0, 1), repeat=8)), float)
    for own, p in zip(y, point):  # no lattice point near it is nearer
        near = np.concatenate([np.rint(own) + whole, np.floor(own) + 0.5 + whole])
        near = near[near.sum(1) % 2 == 0]
        assert np.isclose(((own - p) ** 2).sum(), ((own - near) ** 2).sum(1).min())
    moved = lattice.nearest(point + 1e-3 * y)
    assert np.array_equal(moved, point)


def test_recall_at_the_threshold():
    """A pair at a cosine of 0.9 shares a cell, probed or own, in some table."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    space = lattice.Lattice(64, *lattice.plan(100_000), 0.9)
    a, b = space.cells(x), space.cells(partner(rng, x, 0.9))
    met = ((a[:, :, :1] == b).any(2) | (a == b[:, :, :1]).any(2)).any(1)
    assert met.mean() >= 0.98
    far = ((a[:, :, :1] == np.roll(a, 1, 0)).any(2)).any(1)
    assert far.mean() < 0.05


def planted(rng):
    base = rng.normal(size=(600, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    near = [partner(rng, base[:60], c) for c in np.linspace(0.9001, 0.999, 8)]
    return np.concatenate([base, *near, base[200] + rng.normal(size=(400, 64)) * 0.03, base[:20], 3 * base[300:301].repeat(30, 0)])


def test_links_and_classes(llm, monkeypatch):
    """Pairs from the threshold up, a dense cluster, equal and scaled vectors; whole groups, and block pair by block pair."""
    x = planted(np.random.default_rng(5))
    links, label = brute(x)
    for block, bucket in ((lattice.BLOCK, lattice.BUCKET), (150, 3000)):
        monkeypatch.setattr(lattice, "BLOCK", block)
        monkeypatch.setattr(lattice, "BUCKET", bucket)
        got = {r["vec_id"]: r for r in lattice.near_vectors(frame(llm, x)).collect()}
        found = np.array([got[i]["n_links"] for i in range(len(x))])
        assert (found <= links).all() and found.sum() >= 0.995 * links.sum()
        assert np.mean([got[i]["component_id"] == label[i] for i in range(len(x))]) > 0.995
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_odd(llm):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 5), (2, None, 5), (3, [], 5), (4, [0.0, 0.0, 0.0], 5), (5, [1.0, None, 3.0], 5), (6, [nan, 1.0, 1.0], 5), (7, [inf, 1.0, 1.0], 5), (8, [1.0, 2.0], 5),
            (9, v, 5), (9, v, 5), (None, v, 5), (None, [5.0, -1.0, 0.0], 5), (12, [2e300, 4e300, 6e300], 5), (13, [1e-310, 2e-310, 3e-310], 5), (14, [-1.0, -2.0, -3.0], 5)]
    data = llm.createDataFrame(rows, "vec_id long, embedding array<double>, node int")
    got = [tuple(r) for r in lattice.near_vectors(data).collect()]
    assert len(got) == len(rows)
    by = {i: r for i, *r in got if i is not None}
    assert by[1] == [5, 1, True] and by[9] == [5, 1, False] and by[12] == [5, 1, False] and by[13][1:] == [1, False]
    assert all(by[i] == [0, i, True] for i in (2, 3, 4, 5, 6, 7, 8, 14))
    assert sorted((r[1:] for r in got if r[0] is None), key=str) == [(0, None, True), (5, 1, False)]
    assert lattice.near_vectors(data.limit(0)).count() == 0


def test_query_and_sql(llm):
    verdict, count, note = compare(llm, SF, "op12", lattice.op12_embedding_near_dedup, lattice.ORACLE)
    assert (verdict, count) == ("ok", 500), note
