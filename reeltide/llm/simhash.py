"""SimHash near-dedup: fingerprints in shards of a vantage-point tree; pairs within a few bits form classes."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import staged, table, whole

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints that the tree is built from (a sample; all of them are routed through it).
SAMPLE = 16_384
#: Aim for the members of a shard, and the most that one task compares with each other.
SHARD_ROWS = 65_536
BLOCK_ROWS = 262_144
#: Shards (the tree is broadcast, 24 bytes a node).
MAX_SHARDS = 65_536
_SMALL = 1_024
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingle hashes. No words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - k + 1].tolist()
    ends = ends[k - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        h = np.array([digest(joined[a:z], SEED) for a, z in zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("_t")), np.uint64, b.num_rows)
            yield pa.record_batch([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("_t"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Node:
    """A vantage point, a radius and the two sides; a leaf has a shard number."""
    __slots__ = ("vantage", "radius", "near", "far", "shard")

    def __init__(self, vantage=0, radius=-1, near=None, far=None, shard=-1):
        self.vantage, self.radius, self.near, self.far, self.shard = vantage, radius, near, far, shard


def _split(points: np.ndarray, bits: int):
    """(vantage, radius) that leaves both sides, overlap included, clearly smaller; None if the points do not split."""
    best, least = None, 0.9 * len(points)
    for v in points[np.linspace(0, len(points) - 1, 5, dtype=int)]:
        d = distance(points, v)
        for q in (50, 35, 65):
            r = int(np.percentile(d, q))
            near, far = int((d <= r + bits).sum()), int((d > r).sum())
            if far and max(near, far) < least and near < len(points):
                best, least = (v, r), max(near, far)
                break
    return best


def build_tree(sample: np.ndarray, total: int, bits: int, shard_rows: int = SHARD_ROWS, max_shards: int = MAX_SHARDS) -> tuple[Node, list[int]]:
    """The tree and the rows expected in every shard (overlap included)."""
    each, sizes = total / max(1, len(sample)), []

    def grow(points, depth):
        cut = _split(points, bits) if len(points) * each > shard_rows and len(points) >= 16 and 1 << depth < max_shards else None
        if cut is None:
            sizes.append(int(len(points) * each) + 1)
            return Node(shard=len(sizes) - 1)
        d = distance(points, cut[0])
        return Node(cut[0], cut[1], grow(points[d <= cut[1] + bits], depth + 1), grow(points[d > cut[1]], depth + 1))

    return grow(sample, 0), sizes


def route(node: Node, fp: np.ndarray, bits: int, at: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions): a point goes to its own side, and from the far side also to the near one if within bits of it.

    Two points within bits of each other have distances to any vantage point that differ by at most bits, so one of the
    two follows the other wherever they part, and they meet in a shard.
    """
    at = np.arange(len(fp)) if at is None else at
    if not len(at):
        return
    if node.shard >= 0:
        yield node.shard, at
        return
    d = distance(fp[at], np.uint64(node.vantage))
    yield from route(node.near, fp, bits, at[d <= node.radius + bits])
    yield from route(node.far, fp, bits, at[d > node.radius])


def _star(x: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) that join the points within bits into the same classes as all pairs would."""
    if len(x) <= _SMALL:
        close = distance(x[:, None], x[None, :]) <= bits
        if close.sum() == len(x):
            return
        label = np.arange(len(x))
        while True:
            least = np.where(close, label[None, :], len(x)).min(1)
            if (least == label).all():
                break
            label = least
        linked = label != np.arange(len(x))
        yield x[linked], x[label[linked]]
        return
    cut = _split(x, bits)
    if cut is not None:
        d = distance(x, cut[0])
        yield from _star(x[d <= cut[1] + bits], bits)
        yield from _star(x[d > cut[1]], bits)
        return
    left = x  # too dense to split: walk class by class, every point once against what is left
    while len(left):
        front, left = left[:1], left[1:]
        while len(front):
            p, front = front[0], front[1:]
            hit = distance(left, p) <= bits
            if hit.any():
                found, left = left[hit], left[~hit]
                yield found, np.full(len(found), p)
                front = np.concatenate([front, found])


def _deal(tree, sizes, bits: int):
    """Every fingerprint to its shards. A crowded shard is met block pair by block pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, expected = tree.value, np.asarray(sizes.value)
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, at in route(root, fp, bits):
                n = int(-(-expected[shard] // BLOCK_ROWS))
                if n <= 1:
                    yield pa.record_batch([pa.array(np.full(len(at), shard << 32, np.int64)), pa.array(fp[at].view(np.int64))], names=["cell", "fp"])
                    continue
                block = (fp[at] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                for other in range(n):
                    cell = (shard << 32) + np.minimum(block, other) * n + np.maximum(block, other)
                    yield pa.record_batch([pa.array(cell), pa.array(fp[at].view(np.int64))], names=["cell", "fp"])
    return run


def _links(bits: int):
    def run(group: pa.Table) -> pa.Table:
        x = np.unique(group.column("fp").to_numpy()).view(np.uint64)
        found = list(_star(x, bits))
        a, b = ([np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.uint64)] * 2)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})
    return run


def near_links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): the classes are those of all pairs within bits."""
    spark = distinct.sparkSession
    total = distinct.count()
    sample = [r["fp"] for r in distinct.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()]
    tree, sizes = build_tree(np.array(sample, np.int64).view(np.uint64), total, bits)
    spread = spark.sparkContext.broadcast
    dealt = distinct.select("fp").mapInArrow(_deal(spread(tree), spread(sizes), bits), "cell long, fp long")
    return dealt.groupBy("cell").applyInArrow(_links(bits), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links of at most bits differing bits).

    Equal fingerprints are one node, so copies cost a row, not pairs. A null text has no words and fingerprint 0, which
    links like any other. A null id is never the smallest; a class of null ids has a null component. Repeated rows stay.
    """
    rows = staged(fingerprints(docs, shingle, id_col, text_col), "simhash")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    classes = connected_components(staged(near_links(distinct, bits), "simhash-links"))
    named = distinct.join(classes, distinct["fp"] == classes["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    smallest = named.groupBy("c").agg(F.min("least").alias("component_id"))
    member = staged(named.select("fp", "c").join(smallest, "c").select("fp", "component_id"), "simhash-classes")
    return rows.join(member, "fp", "left").select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
