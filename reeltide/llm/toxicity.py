"""Toxicity: a factorization machine over hashed terms, so that pairs of terms count beside single ones."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import table, whole

#: The bounded sample of labelled rows that the machine is fitted on.
SAMPLE_ROWS = 20_000
BINS = 1 << 18
FACTORS = 4
#: A term must be in so many documents of the sample, and its share among toxic ones differ so clearly (chi square), to get a weight.
MIN_DOCS = 3
MIN_CHI_SQUARE = 10.8
#: Besides the word, its first bytes are terms, which compounds share.
PREFIXES = (4, 5, 6)
ROUNDS = 30
#: Shrinkage of the weights, and the most that a document of the rarer label counts.
SHRINK = 0.3
MAX_WEIGHT = 4.0
_BATCH = 256


def terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row, bin): the distinct hashed terms of each text. A term is a run of letters in lower case."""
    for lo, hi, data, offsets in scan.slices(texts, 2 << 20):
        data = scan.LOWER[data]
        starts, ends, first = scan.word_bounds(data, offsets, scan.NO_LETTER)
        row = np.repeat(np.arange(hi - lo), np.diff(first)) * BINS
        keys = [row + (scan.word_hashes(data, starts, ends) % np.uint64(BINS)).astype(np.int64)]
        for n in PREFIXES:
            long = ends - starts > n
            a = starts[long]
            keys.append(row[long] + ((scan.word_hashes(data, a, a + n) + np.uint64(n)) % np.uint64(BINS)).astype(np.int64))
        key = np.unique(np.concatenate(keys))
        yield lo, hi, key // BINS, key % BINS


def _clear(row: np.ndarray, bins: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which bins are in enough documents and tell the labels apart."""
    n, toxic = len(label), label.sum()
    both, with_term = np.bincount(bins, label[row], minlength=BINS), np.bincount(bins, minlength=BINS)
    spread = with_term * (n - with_term) * toxic * (n - toxic)
    chi = n * (both * n - with_term * toxic) ** 2 / np.maximum(spread, 1)
    return (with_term >= MIN_DOCS) & (chi >= MIN_CHI_SQUARE)


class FactorizationMachine:
    """score = sigmoid(bias + sum of weights + sum over pairs of the product of their factors), over the terms present."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    @classmethod
    def fit(cls, row: np.ndarray, bins: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, seed: int = 0) -> FactorizationMachine:
        """Adaptive gradient steps on the logistic loss with shrinkage; terms in few documents keep weight 0.

        row is ascending. Without labelled rows every text scores the starting bias.
        """
        rng = np.random.default_rng(seed)
        n = len(label)
        share = (label.sum() + 0.5) / (n + 1.0) if n else 0.1
        bias = float(np.log(share / (1 - share)))
        weights, factors = np.zeros(BINS, np.float32), np.zeros((BINS, FACTORS), np.float32)
        known = np.flatnonzero(_clear(row, bins, label))
        place = np.full(BINS, -1)
        place[known] = np.arange(len(known))
        use = place[bins] >= 0
        row, feature = row[use], place[bins[use]]
        edge = np.searchsorted(row, np.arange(n + 1))
        w, v = np.zeros(len(known)), rng.normal(0, 0.02, (len(known), FACTORS))
        gw, gv, gb = np.full(len(known), 1e-2), np.full((len(known), FACTORS), 1e-2), 1e-2
        documents = max(1, n)
        weight = min(MAX_WEIGHT, ((n - label.sum()) / max(1.0, label.sum())) ** 0.5)  # the rarer label counts more
        for r in range(rounds):
            rate = 0.2 / (1 + r / 10)
            for part in np.array_split(rng.permutation(n), max(1, n // _BATCH)):
                sizes = edge[part + 1] - edge[part]
                if not sizes.sum():
                    continue
                at = np.repeat(edge[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                f, of = feature[at], np.repeat(np.arange(len(part)), sizes)
                vf = v[f]
                total = np.stack([np.bincount(of, vf[:, k], minlength=len(part)) for k in range(FACTORS)], 1)
                squares = np.bincount(of, (vf * vf).sum(1), minlength=len(part))
                z = bias + np.bincount(of, w[f], minlength=len(part)) + 0.5 * ((total * total).sum(1) - squares)
                miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[part]) * np.where(label[part] > 0, weight, 1.0)
                touched, back = np.unique(f, return_inverse=True)
                step = np.bincount(back, miss[of]) + SHRINK * w[touched] * len(part) / documents
                gw[touched] += step * step
                w[touched] -= rate * step / np.sqrt(gw[touched])
                for k in range(FACTORS):
                    s = np.bincount(back, miss[of] * (total[of, k] - vf[:, k])) + 2 * SHRINK * v[touched, k] * len(part) / documents
                    gv[touched, k] += s * s
                    v[touched, k] -= 0.1 * rate * s / np.sqrt(gv[touched, k])
                g = miss.sum()
                gb += g * g
                bias -= rate * g / np.sqrt(gb)
        weights[known], factors[known] = w, v
        return cls(bias, weights, factors)

    def scores(self, row: np.ndarray, bins: np.ndarray, n: int) -> np.ndarray:
        vf = self.factors[bins]
        pairs = sum(np.bincount(row, vf[:, k], minlength=n) ** 2 for k in range(FACTORS)) - np.bincount(row, (vf * vf).sum(1), minlength=n)
        z = self.bias + np.bincount(row, self.weights[bins], minlength=n) + 0.5 * pairs
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, row, bins in terms(b.column("_t")):
            ends = np.searchsorted(row, np.arange(hi - lo + 1))
            yield pa.record_batch([b.column("_h").slice(lo, hi - lo), b.column("label").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bins.astype(np.int32)))], names=["_h", "label", "bins"])


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine:
    """Fit on the sample_rows labelled documents of the smallest id hash (all if fewer). Null labels and ids are left out."""
    key = F.xxhash64(F.lit("toxic"), F.col(id_col))
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"), key.alias("_h")).distinct().orderBy("_h", "_id", "label").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_t")).join(F.broadcast(chosen), "_id")
    rows = texts.select("_h", "label", "_t").mapInArrow(_featurise, "_h long, label int, bins array<int>").toArrow().sort_by([("_h", "ascending"), ("label", "ascending")])
    bins = rows.column("bins").combine_chunks()
    flat = np.asarray(bins.flatten(), dtype=np.int64)
    return FactorizationMachine.fit(np.repeat(np.arange(rows.num_rows), np.asarray(bins.value_lengths(), dtype=np.int64)), flat, rows.column("label").to_numpy().astype(float))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for b in batches:
            for lo, hi, row, bins in terms(b.column("_t")):
                yield pa.record_batch([b.column("row").slice(lo, hi - lo), pa.array(machine.scores(row, bins, hi - lo).astype(float))], names=["row", "score"])
    return run


def score(docs: DataFrame, machine: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """row (all columns of docs) and score, from the whole text alone. An empty or null text gets the bias's score."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole(text_col).alias("_t"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return rows.mapInArrow(_score(shared), f"row {docs.schema.simpleString()}, score double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = learn(docs, labels.filter(~held_out()))
    out = score(docs.select("doc_id", "text"), machine)
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
