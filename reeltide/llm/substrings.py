"""Substring dedup: Rabin-Karp hashes of every window of tokens; repeated windows merge into removal intervals."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import staged, table, whole

WINDOW = 20
#: Words of an anchor: every window has a smallest anchor, equal windows have the same.
ANCHOR = 8
#: Bits of the filter of repeated anchors: at most 16 MB. More anchors only let more windows through.
MAX_FILTER_BITS = 27
WINDOWS_A_BUCKET = 500_000
#: Bytes of text whose anchors are counted at a time; Spark adds the counts up.
COUNTED_BYTES = 1 << 20
_LAST_ID = (1 << 63) - 1


def _windows(data, offsets, window):
    """Word counts of the rows, and of every window its row, start, hash, anchor and the anchor's place."""
    starts, ends, first = scan.word_bounds(data, offsets)
    words = scan.word_hashes(data, starts, ends)
    counts = np.diff(first)
    k = min(ANCHOR, window)
    h = scan.rolling(words, window, scan.WORD_BASE)
    least, place = scan.mix(scan.rolling(words, k, scan.BASE)), np.arange(max(0, len(words) - k + 1))
    width, have = window - k + 1, 1
    while have < width:  # leftmost minimum over width neighbours, by doubling
        step = min(have, width - have)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.where(right, least[step:], least[:-step])
        have += step
    row = np.repeat(np.arange(len(counts)), counts)
    fits = row[window - 1:] == row[:len(row) - window + 1] if len(row) >= window else np.zeros(0, bool)
    at = np.flatnonzero(fits)
    return counts, row[at], (at - first[row[at]]), h[at], least[at], place[at]


def _anchor_counts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in scan.slices(b.column("_t"), COUNTED_BYTES):
                _, _, _, _, anchor, place = _windows(data, offsets, window)
                if len(anchor):
                    new = np.concatenate([[True], place[1:] != place[:-1]])
                    found, n = np.unique(anchor[new], return_counts=True)
                    yield pa.record_batch({"anchor": pa.array(found.view(np.int64)), "n": pa.array(np.minimum(n, 2).astype(np.int32))})
    return run


def _filter_bits(anchor: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return [(anchor & mask).astype(np.int64), ((anchor >> np.uint64(32)) & mask).astype(np.int64)]


def _repeated_filter(counted: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter (two bits an anchor) of the anchors that occur twice or more; its size is bounded."""
    repeated = staged(counted.filter("n > 1").select("anchor"), "anchors")
    bits = min(MAX_FILTER_BITS, max(10, (16 * repeated.count()).bit_length()))
    places = F.array(F.col("anchor").bitwiseAND((1 << bits) - 1), F.shiftrightunsigned("anchor", 32).bitwiseAND((1 << bits) - 1))
    words = (repeated.select(F.explode(places).alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m")).toPandas())
    out = np.zeros(max(1, 1 << bits >> 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64)
    return out.view(np.uint64), bits


_ASKED = "bucket int, kind int, hash binary, anchor binary, id binary, tag binary, start binary"
_SPANS = "_id long, _tag long, lo int, hi int"


def _runs(row_id, tag, start):
    """Consecutive starts of one document as (id, tag, first, last)."""
    if not len(start):
        return {k: pa.array([], pa.int64() if k[0] == "_" else pa.int32()) for k in ("_id", "_tag", "lo", "hi")}
    order = np.lexsort((start, tag, row_id))
    i, g, s = row_id[order], tag[order], start[order]
    new = np.concatenate([[True], (i[1:] != i[:-1]) | (g[1:] != g[:-1]) | (s[1:] > s[:-1] + 1)])
    a = np.flatnonzero(new)
    z = np.concatenate([a[1:], [len(s)]]) - 1
    return {"_id": pa.array(i[a]), "_tag": pa.array(g[a]), "lo": pa.array(s[a].astype(np.int32)), "hi": pa.array(s[z].astype(np.int32))}


def _others(order, new, i, g, start):
    """The members of every group but its first; a window of a repeated row (same id, text and start) is no other window."""
    if not len(order):
        return order
    head = order[new][np.cumsum(new) - 1]
    return order[~new & ((i[order] != i[head]) | (g[order] != g[head]) | (start[order] != start[head]))]


def _candidates(window: int, filter_words, bits: int, buckets: int):
    """Windows whose anchor is repeated: of each the first in the slice is asked about, the others are known repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = filter_words.value
        for b in batches:
            ids, tags = b.column("_id").to_numpy(zero_copy_only=False), b.column("_tag").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in scan.slices(b.column("_t")):
                _, row, start, h, anchor, _ = _windows(data, offsets, window)
                keep = np.ones(len(h), bool)
                for place in _filter_bits(anchor, bits):
                    keep &= (seen[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
                row, start, h, anchor = row[keep], start[keep], h[keep], anchor[keep]
                if not len(h):
                    continue
                i, g = ids[lo:hi][row], tags[lo:hi][row]
                key = h ^ scan.mix(anchor)
                order = np.lexsort((start, g, i, key))
                new = np.concatenate([[True], (key[order][1:] != key[order][:-1])])
                first = order[new]
                again = _others(order, new, i, g, start)
                bucket = ((key[first] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)  # by window: a hot anchor spreads
                by = np.lexsort((start[first], g[first], i[first], bucket))
                first, bucket = first[by], bucket[by]
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                out = [[], [], [], [], [], [], []]
                for a, z in zip(cut, [*cut[1:], len(first)]):
                    f = first[a:z]
                    for col, v in zip(out, (int(bucket[a]), 0, h[f].tobytes(), anchor[f].tobytes(), i[f].tobytes(), g[f].tobytes(), start[f].astype(np.int32).tobytes())):
                        col.append(v)
                if len(again):
                    for col, v in zip(out, (int(row[again[0]] * 2654435761 % buckets), 1, b"", b"", i[again].tobytes(), g[again].tobytes(), start[again].astype(np.int32).tobytes())):
                        col.append(v)
                yield pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), *[pa.array(c, pa.binary()) for c in out[2:]]], names=["bucket", "kind", "hash", "anchor", "id", "tag", "start"])
    return run


def _resolve(group: pa.Table) -> pa.Table:
    """Of the asked windows of a bucket, all but the earliest of each hash; and the known repeats."""
    def col(rows, name, dtype):
        return np.frombuffer(b"".join(rows.column(name).to_pylist()), dtype)
    kind = group.column("kind").to_numpy()
    asked, known = group.filter(pa.array(kind == 0)), group.filter(pa.array(kind == 1))
    h, anchor = col(asked, "hash", np.uint64), col(asked, "anchor", np.uint64)
    i, g, s = (col(asked, n, d) for n, d in (("id", np.int64), ("tag", np.int64), ("start", np.int32)))
    key = h ^ scan.mix(anchor)
    order = np.lexsort((s, g, i, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
    late = _others(order, new, i, g, s)
    ki, kg, ks = (col(known, n, d) for n, d in (("id", np.int64), ("tag", np.int64), ("start", np.int32)))
    return pa.table(_runs(np.concatenate([i[late], ki]), np.concatenate([g[late], kg]), np.concatenate([s[late], ks])))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Runs of window starts (_id, _tag, lo, hi) whose words also start earlier; docs has _id, _tag, _t.

    Equal windows share their smallest anchor. Anchors are counted in Spark first; only windows with a repeated anchor go
    on, packed as binary columns by window hash and anchor, and are compared by a 64-bit window hash together with the anchor's hash.
    A window met often inside a slice is asked about once, so a passage in every document costs one entry a slice.
    """
    spark = docs.sparkSession
    anchors = docs.select("_t").mapInArrow(_anchor_counts(window), "anchor long, n int")
    counted = staged(anchors.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1"), "anchor-counts")
    words, bits = _repeated_filter(counted)
    windows = 2 * (counted.agg(F.sum("n")).first()[0] or 0) * (window - ANCHOR + 1)
    buckets = max(8, windows // WINDOWS_A_BUCKET)
    shared = spark.sparkContext.broadcast(words)
    packed = docs.select("_id", "_tag", "_t").mapInArrow(_candidates(window, shared, bits, buckets), _ASKED)
    return packed.groupBy("bucket").applyInArrow(_resolve, _SPANS)


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            for text, runs in zip(b.column("_t"), b.column("_runs")):
                words, runs = text.as_py().encode().split(), runs.as_py() or []
                gone, at, left = [], 0, []
                for lo, hi in sorted((r["lo"], r["hi"] + window) for r in runs):
                    if gone and lo <= gone[-1][1]:
                        gone[-1] = (gone[-1][0], max(hi, gone[-1][1]))
                    else:
                        gone.append((lo, hi))
                for lo, hi in gone:
                    left += words[at:lo]
                    at = hi
                left += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
                spans.append([{"first": lo, "end": hi} for lo, hi in gone])
            yield pa.record_batch([b.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()),
                                   pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))], names=["row", "n_words", "n_removed", "kept_text", "removed"])
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (all columns of docs), n_words, n_removed, kept_text (kept words joined by blanks), removed (word ranges).

    Earlier means: smaller id, then (rows of one id) the hash of the text, then the earlier start; a null id comes last.
    Rows alike in id and text count as one document. A null text has no words. An empty table gives an empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    tagged = docs.select(row.alias("row"), whole(text_col).alias("_t"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)).alias("_id")).withColumn("_tag", F.xxhash64("_t"))
    runs = repeated_windows(tagged, window).groupBy("_id", "_tag").agg(F.collect_list(F.struct("lo", "hi")).alias("_runs"))
    joined = tagged.join(runs, ["_id", "_tag"], "left").select("row", "_t", "_runs")
    return joined.mapInArrow(_cut(window), f"row {docs.schema.simpleString()}, n_words long, n_removed long, kept_text string, removed array<struct<first:int,end:int>>")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
