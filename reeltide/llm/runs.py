"""Periodic runs of words: an enhanced suffix array over the words of every text, branching squares, runs, collapsed text."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan
from .common import let, table, whole, words

MIN_LENGTH = 6
MIN_REPEATS = 4
#: Bytes of text that one suffix array holds; a longer text is one of its own.
SLICE_BYTES = 1 << 20
#: Rotations that all squares try side by side before the rest go on in growing steps.
_SHORT = 16
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffix array, its inverse, ranks by prefixes of 1, 2, 4, ... symbols). Suffixes told apart are not sorted again."""
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    ordered = symbols[sa]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(head, n))
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(head, sizes)
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    levels, h = [rank.astype(np.int32)], 1
    while len(slots):
        own = sa[slots]
        after = own + h
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        sa[slots] = own
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(head, len(own)))
        rank[own] = np.repeat(slots[head], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        levels.append(rank.astype(np.int32))
        h *= 2
    return sa, rank, levels


def lcp_array(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common prefix of every suffix with the one before it in order; 0 at both ends. Prefixes of falling powers of two are compared by rank."""
    n = len(sa)
    out = np.zeros(n + 1, np.int64)
    if n < 2:
        return out
    at = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b = sa[at - 1], sa[at]
    far = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + far, b + far
        open_ = np.flatnonzero((i < n) & (j < n))
        same = open_[levels[k][i[open_]] == levels[k][j[open_]]]
        far[same] += 1 << k
    out[at] = far
    return out


def _smaller_before(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For positions at, the nearest earlier position with a smaller value; x[0] is smaller than all asked."""
    near = np.arange(-1, len(x) - 1)
    left = at
    while len(left):
        left = left[x[near[left]] >= x[left]]
        near[left] = near[near[left]]
    return near


def branching_squares(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all squares that the next symbol does not continue.

    Every LCP interval of depth d asks for each suffix i of its children, but the largest, whether suffix i + d or i - d lies in
    the interval and in another child (a look into the inverse suffix array): then a square of period d starts at the smaller.
    """
    n = len(symbols)
    sa, isa, levels = suffix_array(symbols)
    lcp = lcp_array(sa, levels)
    del levels
    inner = np.flatnonzero(lcp)
    if not len(inner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _smaller_before(lcp, inner)[inner]
    high = n - _smaller_before(lcp[::-1], n - inner[::-1])[n - inner] - 1
    _, first, name = np.unique(low * (n + 1) + high, return_index=True, return_inverse=True)
    interval = np.zeros(n + 1, np.int64)
    interval[inner] = name
    low, high, depth = low[first], high[first], lcp[inner[first]]
    single = np.arange(n)
    a, z = np.concatenate([low, single]), np.concatenate([high, single])
    edge = np.where(lcp[a] >= lcp[z + 1], a, z + 1)
    child = np.flatnonzero(lcp[edge])
    a, z, parent = a[child], z[child], interval[edge[child]]
    order = np.lexsort((z - a, parent))
    a, z, parent = a[order], z[order], parent[order]
    small = np.flatnonzero(parent[:-1] == parent[1:])  # the last child of a parent is a largest one
    a, z, parent = a[small], z[small], parent[small]
    size = z - a + 1
    of = np.repeat(np.arange(len(a)), size)
    i = sa[np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + a[of]]
    d, lo, hi, own_lo, own_hi = depth[parent][of], low[parent][of], high[parent][of], a[of], z[of]
    starts, periods = [], []
    for j in (i + d, i - d):
        at = np.flatnonzero((j >= 0) & (j < n))
        r = isa[j[at]]
        at = at[(r >= lo[at]) & (r <= hi[at]) & ((r < own_lo[at]) | (r > own_hi[at]))]
        starts.append(np.minimum(i[at], j[at]))
        periods.append(d[at])
    both = np.unique(np.concatenate(starts) * (n + 1) + np.concatenate(periods))
    return both // (n + 1), both % (n + 1)


def _rotate(symbols: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The leftmost start to which every square rotates."""
    start = start.copy()
    live = np.arange(len(start))
    for _ in range(_SHORT):
        live = live[start[live] > 0]
        live = live[symbols[start[live] - 1] == symbols[start[live] - 1 + period[live]]]
        start[live] -= 1
    for k in live:
        at, p, step = int(start[k]), int(period[k]), 64
        while at:
            step = min(step, at)
            unlike = np.flatnonzero(symbols[at - step:at] != symbols[at - step + p:at + p])
            if len(unlike):
                at += int(unlike[-1]) + 1 - step
                break
            at, step = at - step, step * 2
        start[k] = at
    return start


def find_runs(symbols: np.ndarray, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs by start and period; period is the smallest one.

    A branching square marks the right end of a run. Of the squares of one end the shortest is rotated first; squares whose period is a
    multiple of it inside its run are merged into it, the others go on.
    """
    at, period = branching_squares(symbols)
    end = at + 2 * period
    order = np.lexsort((period, end))
    at, period, end = at[order], period[order], end[order]
    found = [np.zeros((3, 0), np.int64)]
    while len(at):
        head = np.concatenate([[True], end[1:] != end[:-1]])
        left = _rotate(symbols, at[head], period[head])
        found.append(np.stack([left, end[head] - left, period[head]]))
        group = np.cumsum(head) - 1
        stay = ~head & ((period % period[head][group] != 0) | (at < left[group]))
        at, period, end = at[stay], period[stay], end[stay]
    start, length, period = np.concatenate(found, axis=1)
    enough = length >= np.maximum(min_length, min_repeats * period)
    order = np.lexsort((period[enough], start[enough]))
    return start[enough][order], length[enough][order], period[enough][order]


def text_runs(texts: pa.Array, min_length: int, min_repeats: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """(words, start, length, period) of every text."""
    for lo, hi, data, offsets in scan.slices(texts, SLICE_BYTES):
        starts, ends, first = scan.word_bounds(data, offsets)
        text_of = np.repeat(np.arange(hi - lo), np.diff(first[:hi - lo + 1]))
        _, word = np.unique(scan.word_hashes(data, starts, ends), return_inverse=True)
        at, length, period = find_runs(text_of * (len(word) + 1) + word, min_length, min_repeats)
        bound = np.searchsorted(at, first[:hi - lo + 1])
        raw = data.tobytes()
        for k in range(hi - lo):
            own = slice(bound[k], bound[k + 1])
            yield raw[offsets[k]:offsets[k + 1]].split(), at[own] - first[k], length[own], period[own]


def collapse(own: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words joined by blanks, of every run only the first period."""
    if not len(start):
        return b" ".join(own)
    step = np.zeros(len(own) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    return b" ".join([own[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0)])


def _apply(carried: list[str], min_length: int, min_repeats: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, counts, parts, texts = [], [], [np.zeros((3, 0), np.int64)], []
            for own, *spans in text_runs(b.column("_t"), min_length, min_repeats):
                sizes.append(len(own))
                counts.append(len(spans[0]))
                parts.append(np.stack(spans))
                texts.append(collapse(own, *spans).decode())
            flat = pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(parts, axis=1)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), flat)
            yield pa.record_batch([*[b.column(c) for c in carried], pa.array(sizes, pa.int64()), lists, pa.array(texts, pa.string())], names=[*carried, "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (struct of the columns in keep, else of all), n_words, runs (start, length, period in words, by start and period), collapsed (text).

    A run is a stretch with smallest period q and at least max(min_length, min_repeats * q) words that no neighbouring word
    extends. Words after the first q of a run are dropped from collapsed, whose words are joined by one blank. A null text has
    no words, no runs and an empty collapsed text. Rows are independent: repeated rows, ids and ties need no rule, other columns stay in row.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), whole(text_col).alias("_t"))
    schema = rows.select("row").schema.add("n_words", "long").add("runs", RUNS).add("collapsed", "string")
    return rows.mapInArrow(_apply(["row"], min_length, min_repeats), schema)


def repeated_from(text: Column, doc_id: Column) -> Column:
    """The text of the query: where crc32 of the id is divisible by ten, the words from a on repeat the p words at a."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def repeat(own: Column) -> Column:
        n = F.size(own).cast("long")
        a = g % n
        span = F.struct(a.alias("a"), (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")).alias("p"))
        copied = let(span, lambda s: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(own, F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int"))))
        return F.when(n > 0, F.array_join(copied, " ")).otherwise(text)

    return F.when(h % 10 == 0, let(words(text), repeat)).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_from(whole(), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs, keep=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "runs", "collapsed")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    period = -best["period"]
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), period.alias("period"),
        F.floor(1000 * best["length"] / period).cast("long").alias("exponent_milli"), F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
