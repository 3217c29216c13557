"""Packing: repeat counts of shallow length combinations by non-negative least squares, residuals greedily."""
from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, table, whole
from .tokens import byte_chars

WORD_BPE = "word_bpe_49k.json"
LENGTH = 4096
END_ID = 2
#: Width of a length class, and the most pieces of a combination.
CLASS = 256
DEPTH = 4
#: Ids packed together. A block is packed by itself, so nothing is shuffled.
BLOCK_IDS = 4_000_000
MEMORY = 400_000


#: Letters that lower case and normal form treat one by one, with sentence marks behind: two pieces for the tokenizer's model.
_SIMPLE = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?]*)")


class WordEncoder(dict):
    """Packed ids of words between blanks. The tokenizer drops white space, so a text's ids are those of its words.

    Words of plain letters go straight to the tokenizer's BPE model, which is much cheaper than its whole chain.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.stand_in = {b: c for c, b in byte_chars().items()}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.stand_in)
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()
            if len(piece) <= 64:
                self.pieces[piece] = found
        return found

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        simple = _SIMPLE.fullmatch(text)
        if simple:
            found = self._piece(simple[1].lower()) + (self._piece(simple[2]) if simple[2] else b"")
        else:
            found = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= 64:
            self[word] = found
        return found

    def encode(self, text: str, end: bytes) -> bytes:
        if len(self) > MEMORY:
            self.clear()
        if len(self.pieces) > MEMORY:
            self.pieces.clear()
        return b"".join(map(self.__getitem__, text.encode().split())) + end


@held
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=4)
def combinations(length: int, width: int = CLASS, depth: int = DEPTH) -> np.ndarray:
    """Rows: how many pieces of each class (class c holds lengths up to (c + 1) * width) fill a sequence of that length."""
    classes = length // width
    rows = []
    for n in range(1, depth + 1):
        for c in combinations_with_replacement(range(classes), n):
            if classes - 1 <= sum(c) + n <= classes:  # at most one class of slack by upper ends
                rows.append(np.bincount(c, minlength=classes))
    return np.array(rows, np.float64)


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 with small |a x - b|, by multiplicative steps (a and b are not negative)."""
    x = np.full(a.shape[1], b.sum() / max(1.0, a.sum()))
    gram, goal = a.T @ a, a.T @ b
    for _ in range(rounds):
        x *= goal / (gram @ x + 1e-9)
    return x


def pack(lengths: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, size) that hold every id of every document once.

    Whole sequences of a long document stand alone. The rests are counted in classes; combinations repeated as often as
    the rounded-down solution says take the largest rests of their classes first. A gap in a sequence and all residual
    rests are filled greedily, cutting the piece that does not fit. Only the last ids of a block make shorter sequences,
    of sizes that are powers of two, so nothing is padded.
    """
    out = [[(d, at, length)] for d in np.flatnonzero(lengths >= length) for at in range(0, int(lengths[d]) - length + 1, length)]
    rest = lengths % length
    shelves = [[] for _ in range(length // CLASS)]
    for d in np.argsort(rest, kind="stable"):
        if rest[d]:
            shelves[(rest[d] - 1) // CLASS].append(int(d))
    counts = np.array([len(s) for s in shelves], np.float64)
    combos = combinations(length)
    repeats = np.floor(nonnegative_least_squares(combos.T, counts) + 1e-6).astype(int)
    order = np.argsort(-repeats * combos.sum(1), kind="stable")
    drafts, left = [], counts.astype(int)
    for k in order:
        need = combos[k].astype(int)
        n = min([int(repeats[k]), *(left[need > 0] // need[need > 0])])
        left = left - n * need
        for _ in range(n):
            drafts.append([shelves[c].pop() for c in np.repeat(np.arange(len(need)), need)])
    residual = [d for s in reversed(shelves) for d in s]  # largest first
    queue = [(d, int(lengths[d] - rest[d]), int(rest[d])) for d in residual]
    queue.reverse()
    for draft in drafts:
        pieces = [(d, int(lengths[d] - rest[d]), int(rest[d])) for d in draft]
        gap = length - sum(p[2] for p in pieces)
        _fill(pieces, gap, queue)
        out.append(pieces)
    total = sum(p[2] for p in queue)
    for pieces in out[len(out) - len(drafts):]:  # no residual was left for these: they are short, take them apart
        if sum(p[2] for p in pieces) < length:
            total += sum(p[2] for p in pieces)
            queue += pieces
            pieces.clear()
    out = [p for p in out if p]
    while total:
        size = length if total >= length else 1 << total.bit_length() - 1
        pieces = []
        _fill(pieces, size, queue)
        out.append(pieces)
        total -= size
    return out


def _fill(pieces: list, gap: int, queue: list) -> None:
    """Move ids from the end of the queue into the gap, cutting the last piece."""
    while gap and queue:
        d, start, size = queue.pop()
        take = min(size, gap)
        pieces.append((d, start, take))
        gap -= take
        if take < size:
            queue.append((d, start + take, size - take))


def _pack_blocks(path: str, length: int, end_id: int, block_ids: int):
    end = np.uint32(end_id).tobytes()

    def block(ids, texts, first):
        sizes = np.array([len(t) // 4 for t in texts], np.int64)
        sequences = pack(sizes, length)
        for at in range(0, len(sequences), 512):
            part = sequences[at:at + 512]
            rows = [(ids[d], start, size, texts[d][4 * start:4 * (start + size)], int(sizes[d]), first + at + k) for k, s in enumerate(part) for d, start, size in s]
            offsets = np.concatenate([np.cumsum([0] + [p[2] for p in s])[:-1] for s in part])
            cols = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.record_batch([*[pa.array(c, k) for c, k in zip(cols, kinds)], pa.array(offsets.astype(np.int64))], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        return len(sequences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        number = TaskContext.get().partitionId() << 40
        ids, texts, held = [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("_t").to_pylist()):
                    ids.append(i)
                    texts.append(encoder.encode(t, end))
                    held += len(texts[-1]) // 4
                    if held >= block_ids:
                        number += yield from block(ids, texts, number)
                        ids, texts, held = [], [], 0
        if ids:
            yield from block(ids, texts, number)
    return run


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids (packed little-endian 32-bit), doc_tokens, sequence_id, offset.

    Each task packs blocks of its own rows; sequence ids hold the partition, so a task that runs again gives the same
    ids. An empty or null text is its end id. Rows of one id are documents of their own. No rows: no pieces.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("_t"))
    return rows.mapInArrow(_pack_blocks(path, length, end_id, block_ids), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pieces_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pieces_digest(pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)))
