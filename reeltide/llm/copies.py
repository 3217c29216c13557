"""Near copies: op8's links, and pairs of texts whose sets of five-word shingles are alike to 0.8 or more.

Candidates are texts that share a band of MinHash values; each is compared exactly, set against set.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import scan, simhash, urls
from .common import forget, staged, whole

SHINGLE = 5
#: A pair at a similarity of 0.8 misses all bands with a probability of (1 - 0.8 ** 6) ** 40, about 5e-6.
BANDS = 40
BAND_VALUES = 6
#: Texts and shingles that a block of a group of candidates holds; larger groups are met block pair by block pair.
BLOCK_TEXTS = 512
BLOCK_SHINGLES = 1_000_000
#: Bytes of text hashed at a time (a longer text is hashed alone).
SLICE_BYTES = 1 << 20
#: Entries of a bucket of band cells.
BUCKET = 200_000
_CHUNK = 4_096


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of every text; a shorter text is one shingle, no words give none."""
    for lo, hi, data, offsets in scan.slices(texts, SLICE_BYTES):
        data = scan.LOWER[data]
        starts, ends, first = scan.word_bounds(data, offsets)
        words = scan.word_hashes(data, starts, ends)
        runs = scan.mix(scan.rolling(words, shingle) + scan.U(shingle))
        for a, z in zip(first[:hi - lo], first[1:hi - lo + 1]):
            n = z - a
            yield np.unique(runs[a:z - shingle + 1]) if n >= shingle else scan.mix(scan.rolling(words[a:z], n) + scan.U(n)) if n else runs[:0]


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for every band of a set."""
    rng = np.random.default_rng(11)
    factors = (rng.integers(0, 1 << 31, BANDS * BAND_VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
    weights = rng.integers(0, 1 << 62, BAND_VALUES, dtype=np.uint64) * scan.U(2) + scan.U(1)
    least = np.full(BANDS * BAND_VALUES, 0xFFFFFFFF, np.uint32)
    short = own.astype(np.uint32)
    for at in range(0, len(short), _CHUNK):
        np.minimum(least, (short[None, at:at + _CHUNK] * factors).min(1), out=least)
    return scan.mix((least.reshape(BANDS, BAND_VALUES).astype(np.uint64) * weights).sum(1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * scan.U(scan.BASE))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in batches:
        fp, keys, bands = [], [], []
        for text, own in zip(b.column("_t"), shingle_sets(b.column("_t"))):
            fp.append(simhash.fingerprint(text.as_py()))
            keys.append((scan.mix(own).sum(dtype=np.uint64), scan.mix(own ^ scan.U(scan.BASE)).sum(dtype=np.uint64), len(own)))
            bands.append(band_keys(own) if len(own) else own)
        ends = pa.array(np.cumsum([0, *map(len, bands)]), pa.int32())
        flat = pa.array(np.concatenate(bands or [np.zeros(0, scan.U)]).view(np.int64))
        k, m, n = np.array(keys, np.uint64).reshape(-1, 3).T
        yield pa.record_batch([b.column("doc_id"), b.column("tag"), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(np.ascontiguousarray(k).view(np.int64)), pa.array(np.ascontiguousarray(m).view(np.int64)),
                               pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "tag", "fp", "k", "m", "n", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in batches:
        own = pa.array([x.tobytes() for x in shingle_sets(b.column("_t"))], pa.binary())
        yield pa.record_batch([*[b.column(c) for c in ("num", "g", "blocks")], own], names=["num", "g", "blocks", "own"])


def _stars(cell: np.ndarray, num: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of the least number of every cell, numbers that share a cell with a lesser one, that one)."""
    order = np.lexsort((num, cell))
    new = np.concatenate([[True], cell[order][1:] != cell[order][:-1]])[:len(order)]
    first = order[new]
    least = num[first][np.cumsum(new) - 1]
    met = np.unique(np.stack([num[order], least])[:, num[order] != least], axis=1)
    return first, met[0], met[1]


def _met_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every cell the least number in the batch (cell, a), and links (a, b) of those that meet here: a hot cell leaves a batch as one row."""
    for b in batches:
        bands = b.column("bands")
        num = np.repeat(b.column("num").to_numpy(), np.diff(bands.offsets.to_numpy()))
        cell = bands.flatten().to_numpy(zero_copy_only=False)
        first, more, least = _stars(cell, num)
        cells = pa.array(np.concatenate([cell[first], np.zeros(len(more), np.int64)]), pa.int64(), mask=np.repeat([False, True], [len(first), len(more)]))
        yield pa.record_batch([cells, pa.array(np.concatenate([num[first], more])), pa.array(np.concatenate([num[first], least]))], names=["cell", "a", "b"])


def _met(group: pa.Table) -> pa.Table:
    _, a, b = _stars(group.column("cell").to_numpy(), group.column("a").to_numpy())
    return pa.table({"a": pa.array(a), "b": pa.array(b)})


def alike(sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, int]]:
    """(positions, position): links that join the sets into the classes of all pairs alike to 0.8 or more.

    Class by class: every set of a class once against the sets that are in none so far. sets are in order of size, none is empty.
    """
    sizes = np.array([len(x) for x in sets])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), np.int32)
    left = np.arange(len(sets))
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            p = front.pop()
            near = left[(5 * sizes[left] >= 4 * sizes[p]) & (4 * sizes[left] <= 5 * sizes[p])]
            if not len(near):
                continue
            lo, hi = near[0], near[-1] + 1
            mark[flat[offsets[p]:offsets[p + 1]]] = 1
            common = np.add.reduceat(mark[flat[offsets[lo]:offsets[hi]]], offsets[lo:hi] - offsets[lo])[near - lo]
            mark[flat[offsets[p]:offsets[p + 1]]] = 0
            found = near[9 * common >= 4 * (sizes[p] + sizes[near])]
            if len(found):
                yield found, p
                front += found.tolist()
                left = np.setdiff1d(left, found, assume_unique=True)


def _links(group: pa.Table) -> pa.Table:
    node = group.column("num").combine_chunks()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("own")]
    order = np.argsort([len(x) for x in sets], kind="stable")
    a, b = [], []
    for found, p in alike([sets[i] for i in order]):
        a += order[found].tolist()
        b += [order[p]] * len(found)
    return pa.table({"a": node.take(pa.array(a, pa.int64())), "b": node.take(pa.array(b, pa.int64()))})


def may_be(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs with _hit: false where (doc_id, tag) is surely not in keys. A Bloom filter of bounded size; a fuller one only lets more through."""
    keys = keys.select(F.xxhash64("doc_id", "tag").alias("key"))
    blocks, n = urls.bloom_filter(keys, keys.count())
    block, masks = urls._places(F.xxhash64("doc_id", "tag"), n)
    found = docs.join(F.broadcast(blocks.withColumnRenamed("block", "_block")), block == F.col("_block"), "left")
    hit = F.lit(True)
    for i, mask in enumerate(masks):
        hit = hit & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    return found.select(*docs.columns, F.coalesce(hit, F.lit(False)).alias("_hit"))


def _alike_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) of node numbers alike to 0.8 or more that share a band."""
    buckets = max(1, -(-nodes.count() * BANDS // BUCKET))
    here = nodes.select("num", "bands").mapInArrow(_met_here, "cell long, a long, b long")
    across = here.filter("cell is not null").select("cell", "a", F.pmod("cell", F.lit(buckets)).alias("bucket")).groupBy("bucket").applyInArrow(_met, "a long, b long")
    met = staged(across.union(here.filter("cell is null").select("a", "b")), "copies-met")
    groups = staged(connected_components(met).toDF("num", "g"), "copies-candidates")
    groups = staged(groups.join(nodes.select("num", "node", "n"), "num"), "copies-groups")
    blocks = groups.groupBy("g").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    asked = groups.join(blocks, "g").select("node.doc_id", "node.tag", "num", "g", "blocks")
    texts = may_be(docs, groups.select("node.*")).filter("_hit").join(asked, ["doc_id", "tag"]).dropDuplicates(["num"])
    sets = texts.select("num", "g", "blocks", "_t").mapInArrow(_sets, "num long, g long, blocks int, own binary")
    own = F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("own_block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("num", "own", "g", F.least("own_block", "other").alias("i"), F.greatest("own_block", "other").alias("j"))
    return dealt.groupBy("g", "i", "j").applyInArrow(_links, "a long, b long")


def text_tag(text_col: str = "text") -> Column:
    return F.xxhash64(whole(text_col))


def tagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag (hash of the text), _t of the rows with an id."""
    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_tag(text_col).alias("tag"), whole(text_col).alias("_t"))


def _texts(docs: DataFrame) -> DataFrame:
    """Of every row its fingerprint, the hash of its shingle set and its bands; written once."""
    return staged(docs.mapInArrow(_prints, "doc_id long, tag long, fp long, k long, m long, n long, bands array<long>"), "copies-texts")


def _classes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node, component. Nodes are numbered, so that links are pairs of numbers."""
    same = rows.groupBy("fp", "k", "m", "n").agg(F.min(F.struct("doc_id", "tag")).alias("node"), F.first("bands").alias("bands"))
    nodes = staged(same.withColumn("num", F.monotonically_increasing_id()), "copies-nodes")
    by_bits = staged(nodes.groupBy("fp").agg(F.min("num").alias("least")), "copies-bits")
    close = simhash.near_links(by_bits)
    ends = [by_bits.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_num")) for c in ("a", "b")]
    links = close.join(ends[0], "a").join(ends[1], "b").select(F.col("a_num").alias("a"), F.col("b_num").alias("b"))
    links = links.union(nodes.select("fp", "num").join(by_bits, "fp").filter("num > least").select("num", "least")).union(_alike_links(docs, nodes))
    classes = staged(connected_components(staged(links, "copies-links")).toDF("num", "c"), "copies-classes")
    told = nodes.select("num", "node").join(classes, "num", "left")
    smallest = told.filter("c is not null").groupBy("c").agg(F.min("node").alias("component"))
    return told.join(smallest, "c", "left").select("node", F.coalesce("component", "node").alias("component"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node, component: of texts alike in fingerprint and shingles one node (doc_id, tag), the smallest; component is the
    smallest node reachable over links. Linked are fingerprints within op8's bits, and sets of five-word shingles alike to
    0.8 or more. Rows without an id are left out. Null and empty texts have no shingles and are alike in both.
    """
    docs = tagged(docs, id_col, text_col)
    return _classes(docs, _texts(docs))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every class of near copies the row smallest by (id, text hash); of rows alike in both the one with the smallest hash of all
    columns; rows without an id all. Columns are those of docs, whatever their names; an empty table stays empty.

    Only rows that may go are shuffled: their keys stand in a Bloom filter, all other rows pass.
    """
    own = tagged(docs, id_col, text_col)
    rows = _texts(own)
    first = _classes(own, rows).filter("node = component").select("node.*", F.lit(True).alias("stays"))
    keys = rows.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("times"))
    asked = staged(keys.join(first, ["doc_id", "tag"], "left").filter("stays is null or times > 1").select("doc_id", "tag", F.coalesce("stays", F.lit(False)).alias("stays")), "copies-asked")
    whole_rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_tag(text_col).alias("tag"))
    flagged = may_be(whole_rows, asked)
    met = flagged.filter("_hit and doc_id is not null").join(asked, ["doc_id", "tag"], "left")
    once = met.filter("stays").groupBy("doc_id", "tag").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return flagged.filter("not _hit or doc_id is null").select("row.*").union(met.filter("stays is null").select("row.*")).union(once.select("row.*"))
