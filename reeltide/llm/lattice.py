"""Embedding near-dedup: projections decoded to points of the E8 lattice bring near vectors together, cosines decide."""
from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import scan
from .common import bounded_broadcast, staged, table

THRESHOLD = 0.9
#: E8 points that make a cell (by the number of vectors), and the tables that keep the chance of two vectors at the threshold to share
#: a cell of some table at 0.99: one table alone gives 0.375, 0.137 and 0.045 with PROBES neighbouring cells asked from both sides.
TABLES = {2: 10, 3: 32, 4: 100}
PROBES = 4
#: Spread of a projection in lattice units, times the distance of two unit vectors at the threshold.
SCALE = 4.92
#: Bits of the sign sketch that candidates are told by, and the deviations from its mean up to which a pair at the threshold is let through.
SKETCH_BITS = 256
DEVIATIONS = 4.2
#: Entries of a bucket of cells, vectors of a block of a group of candidates.
BUCKET = 200_000
BLOCK = 2_048
_SMALL = 64
_CHUNK = 4_096
_ROWS = 512
_PAIRS = 1 << 20
_U = np.uint64


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [(i, j, s, t) for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    a = np.zeros((len(whole), 8))
    for k, (i, j, s, t) in enumerate(whole):
        a[k, i], a[k, j] = s, t
    halves = np.array([x for x in itertools.product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0])
    return np.concatenate([a, halves])


ROOTS = _roots()


def _even_integers(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (whole numbers with an even sum): round, and where the sum is odd the worst rounded goes the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is D8 and D8 moved by one half."""
    a, b = _even_integers(x), _even_integers(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Lattice:
    """Cells of unit vectors of one length: in every table `blocks` projections to eight numbers, each decoded to E8."""

    def __init__(self, dims: int, blocks: int, tables: int, threshold: float, probes: int = PROBES):
        rng = np.random.default_rng([dims, blocks])
        self.blocks, self.tables, self.probes = blocks, tables, probes
        width = SCALE * math.sqrt(2 - 2 * threshold)
        self.projections, self.shifts = [], rng.uniform(0, 1, (tables, 8 * blocks))
        for _ in range(tables):
            p = rng.normal(size=(dims, 8 * blocks))
            self.projections.append((np.linalg.qr(p)[0] * math.sqrt(dims) if dims >= 8 * blocks else p) / width)
        self.weights = rng.integers(0, 1 << 62, (tables, 8 * blocks), dtype=np.uint64) * _U(2) + _U(1)
        step = (2 * ROOTS).astype(np.int64).view(_U)
        self.steps = [np.concatenate([(step * w).sum(1, dtype=_U) for w in ws.reshape(blocks, 8)]) for ws in self.weights]
        self.planes = rng.normal(size=(dims, SKETCH_BITS))

    def cells(self, x: np.ndarray) -> np.ndarray:
        """(vector, table, own cell and then the probed ones): the next lattice points are those whose direction the remainder leans to most."""
        out = np.empty((len(x), self.tables, 1 + self.probes), _U)
        for t in range(self.tables):
            y = (x @ self.projections[t] + self.shifts[t]).reshape(-1, 8)
            point = nearest(y)
            lean = ((y - point) @ ROOTS.T).reshape(len(x), -1)
            near = np.argpartition(-lean, self.probes, axis=1)[:, :self.probes]
            own = ((2 * point).astype(np.int64).view(_U).reshape(len(x), -1) * self.weights[t]).sum(1, dtype=_U)
            out[:, t, 0] = own
            out[:, t, 1:] = own[:, None] + self.steps[t][near]
            out[:, t] = scan.mix(out[:, t] + _U((t + 1) * scan.BASE % (1 << 64)))
        return out

    def sketch(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.planes > 0, axis=1)


@lru_cache(maxsize=8)
def lattice(dims: int, blocks: int, tables: int, threshold: float) -> Lattice:
    return Lattice(dims, blocks, tables, threshold)


def plan(vectors: int) -> tuple[int, int]:
    """(blocks, tables): more blocks for more vectors, so that a cell holds a bounded number of unrelated ones."""
    blocks = min(max(TABLES), max(min(TABLES), math.ceil((math.log2(max(2, vectors)) - 6) / 6.9)))
    return blocks, TABLES[blocks]


def unit_vectors(column: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) by length, at most so many at a time. Scaled by the largest component first, so that squares neither overflow nor vanish."""
    offsets, flat = column.offsets.to_numpy(), column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        for lo in range(0, len(at), most):
            own = at[lo:lo + most]
            x = flat[offsets[own][:, None] + np.arange(d)]
            x = x / np.abs(x).max(1, keepdims=True)
            yield own, x / np.sqrt((x * x).sum(1, keepdims=True))


def _entries(blocks: int, tables: int, threshold: float):
    """Every vector with its sketch to its own cell of each table (an odd tag) and to the probed ones (an even tag)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column("node").to_numpy()
            for own, x in unit_vectors(b.column("vector"), _CHUNK):
                d = x.shape[1]
                space = lattice(d, blocks, tables, threshold)
                cell = scan.mix(space.cells(x) ^ _U(d)).view(np.int64)
                tag = np.zeros(cell.shape, np.int64)
                tag[:, :, 0] = 1
                tag += 2 * node[own][:, None, None]
                each = tables * cell.shape[2]
                sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH_BITS // 8), len(own) * each, [None, pa.py_buffer(np.repeat(space.sketch(x), each, axis=0).tobytes())])
                yield pa.record_batch([pa.array(cell.ravel()), pa.array(tag.ravel()), sketch.cast(pa.binary())], names=["cell", "tag", "sketch"])
    return run


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _walk(seen: np.ndarray, start: Iterator[int], near) -> Iterator[tuple[np.ndarray, int]]:
    """(found, p): links of a forest that joins what near(p, left) joins. Every member is asked once against those in no class yet."""
    left = np.ones(len(seen), bool)
    for first in start:
        if not left[first]:
            continue
        left[first] = False
        front = [first]
        while front:
            p = front.pop()
            rest = np.flatnonzero(left)
            found = rest[near(p, rest)] if len(rest) else rest
            if len(found):
                left[found] = False
                front += found.tolist()
                yield found, p


def _candidates(bound: int):
    """Links of vectors that share a cell, of one of them the own one, and whose sketches are near."""
    def run(group: pa.Table) -> pa.Table:
        cell, tag = (group.column(c).to_numpy() for c in ("cell", "tag"))
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), _U).reshape(len(cell), -1)
        order = np.lexsort((-(tag & 1), cell))  # residents of a cell come first
        cell, tag, sketch = cell[order], tag[order], sketch[order]
        head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.append(head, len(cell)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        end = np.repeat(head + size, size)
        asks = np.flatnonzero((tag & 1 == 1) & (np.repeat(size, size) <= _SMALL) & (end - np.arange(len(cell)) > 1))
        count = end[asks] - asks - 1
        done = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(asks):
            stop = max(at + 1, int(np.searchsorted(done, done[at] + _PAIRS, side="right")) - 1)
            n = count[at:stop]
            left = np.repeat(asks[at:stop], n)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            hit = np.flatnonzero(_far(sketch[left], sketch[right]) <= bound)
            a.append(left[hit])
            b.append(right[hit])
            at = stop
        for lo, n in zip(head[size > _SMALL].tolist(), size[size > _SMALL].tolist()):
            own, resident = sketch[lo:lo + n], tag[lo:lo + n] & 1 == 1
            near = lambda p, rest: (_far(own[rest], own[p]) <= bound) & (resident[p] | resident[rest])  # noqa: E731, B023
            for found, p in _walk(own, range(int(resident.sum())), near):
                a.append(lo + found)
                b.append(np.full(len(found), lo + p))
        a, b = tag[np.concatenate(a)] >> 1, tag[np.concatenate(b)] >> 1
        unlike = a != b
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)])[:, unlike], axis=1)
        return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})
    return run


def _verified(threshold: float):
    """Of every group of candidates: per vector the rows linked to it (node, links), and a forest of links (node, other)."""
    def run(group: pa.Table) -> pa.Table:
        node, part, copies, side = (group.column(c).to_numpy() for c in ("node", "g", "copies", "side"))
        vector = group.column("vector").combine_chunks()
        out = [[np.zeros(0, np.int64)] * 3]
        order = np.lexsort((node, part))
        part_head = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]]))
        for members in np.split(order, part_head[1:]):
            for own, x in unit_vectors(vector.take(pa.array(members)), len(members)):
                at = members[own]
                linked = np.empty((len(at), len(at)), bool)
                for lo in range(0, len(at), _ROWS):
                    linked[lo:lo + _ROWS] = x[lo:lo + _ROWS] @ x.T >= threshold
                np.fill_diagonal(linked, False)
                if (side[at] >= 0).any():  # two blocks of a crowded group: only pairs across
                    linked &= side[at][:, None] != side[at][None, :]
                links = linked @ copies[at]
                some = np.flatnonzero(links)
                out.append([node[at][some], np.full(len(some), -1), links[some]])
                for found, p in _walk(at, range(len(at)), lambda p, rest: linked[p, rest]):  # noqa: B023
                    out.append([node[at][found], np.full(len(found), node[at[p]]), np.zeros(len(found), np.int64)])
        a, b, n = (np.concatenate(c).astype(np.int64) for c in zip(*out))
        return pa.table({"node": a, "other": b, "links": n})
    return run


def valid(vector: Column) -> Column:
    """Not null, not all zero, no null and no non-finite component."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _dealt(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Vectors by group: small groups together in buckets, a crowded group block pair by block pair."""
    sizes = groups.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = staged(groups.join(sizes, "g"), "lattice-groups")
    buckets = max(1, -(-asked.count() // (4 * BLOCK)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = nodes.select("node", "copies", "vector").join(asked, "node").withColumn("own", own).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("own", "met"), F.greatest("own", "met")
    return dealt.select("node", "copies", "vector", "g", F.when(i < j, F.col("own")).otherwise(-1).alias("side"), i.alias("i"), j.alias("j"),
                        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("g"), F.lit(buckets))).otherwise(-1 - F.col("g")).alias("bucket"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: pairs of a cosine of at least threshold (in double precision) are linked.

    Equal vectors are one node that counts its rows. Null and zero vectors, vectors with null or non-finite components and vectors of another
    length link with nothing. component_id is the smallest id reachable, null ids aside; a class of null ids has a null component, and a row is
    kept if its id is that of its component (both null included). Candidates are vectors that share a cell of some table, or one of which probes
    the other's, with near sketches; each group of candidates is then compared all with all, so n_links holds every pair in it.
    """
    spark = vectors.sparkSession
    value = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(valid(value), value).alias("vector"))
    keys = {"k": F.xxhash64("vector"), "m": F.xxhash64(F.lit(1), "vector")}
    same = rows.filter("vector is not null").withColumns(keys).groupBy("k", "m").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    nodes = staged(same.withColumn("node", F.monotonically_increasing_id()), "lattice-nodes")
    total = nodes.count()
    blocks, tables = plan(total)
    angle = math.acos(threshold) / math.pi
    bound = int(SKETCH_BITS * angle + DEVIATIONS * math.sqrt(SKETCH_BITS * angle * (1 - angle)))
    buckets = max(1, -(-total * tables * (1 + PROBES) // BUCKET))
    entries = nodes.select("node", "vector").mapInArrow(_entries(blocks, tables, threshold), "cell long, tag long, sketch binary").withColumn("bucket", F.pmod("cell", F.lit(buckets)))
    crowded = staged(entries.groupBy("bucket").count().filter(F.col("count") > 2 * BUCKET).select("bucket", F.ceil(F.col("count") / BUCKET).cast("int").alias("n")), "lattice-crowded")
    many = crowded.count()
    if many:
        own = F.pmod(F.xxhash64("tag"), F.col("n")).cast("int")
        met = entries.join(bounded_broadcast(crowded, many, 1_000_000), "bucket", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("own", own)
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        grouped = met.select("cell", "tag", "sketch", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).groupBy("bucket", "i", "j")
    else:
        grouped = entries.groupBy("bucket")
    candidates = staged(grouped.applyInArrow(_candidates(bound), "a long, b long"), "lattice-candidates")
    groups = connected_components(candidates).withColumnRenamed("component", "g")
    checked = staged(_dealt(nodes, groups).groupBy("bucket", "i", "j").applyInArrow(_verified(threshold), "node long, other long, links long"), "lattice-links")
    counts = checked.filter("other < 0").groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(checked.filter("other >= 0").select("node", "other"))
    told = nodes.drop("vector").join(counts, "node", "left").join(classes, "node", "left").select("k", "m", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    told = staged(told, "lattice-told")
    smallest = told.groupBy("c").agg(F.min("least").alias("component_id"))
    member = staged(told.join(smallest, "c").select("k", "m", "n_links", "component_id"), "lattice-classes")
    out = rows.withColumns(keys).drop("vector").join(member.withColumn("_linked", F.lit(True)), ["k", "m"], "left")
    component = F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE norms AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
units AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM norms),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id AS node, vec_id AS least FROM embeddings UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.node),
classes AS (SELECT node, min(least) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN classes c ON c.node = e.vec_id LEFT JOIN counts k ON k.node = e.vec_id
"""
