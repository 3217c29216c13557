"""BPE encoding and decoding with a public vocabulary, and encoding by words for packing."""
from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, table, whole

BYTE_BPE = "byte_bpe_50k.json"
#: White space as the tokenizer's pattern has it (Unicode White_Space).
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the split pattern of byte-level BPE.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Entries of a worker's memory of pieces; it starts anew beyond.
MEMORY = 400_000


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes by rank (order of merges), the parts of each token, and the ids of the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_chars()
        ids, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        raw = lambda t: bytes(to_byte[c] for c in t)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = [t for t in to_byte if t in ids]
        ranked = list(dict.fromkeys([*letters, *[a + b for a, b in merges]]))
        rank = {t: i for i, t in enumerate(ranked)}
        self.tokens = [raw(t) for t in ranked]
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        self.ids = np.array([ids[t] for t in ranked], np.int32)
        self.parts = [(i, i) for i in range(len(letters))] + [(-1, -1)] * (len(ranked) - len(letters))
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            pair = rank[a], rank[b]
            self.pairs.setdefault(pair, rank[a + b])
            if self.parts[rank[a + b]] == (-1, -1):
                self.parts[rank[a + b]] = pair
        self.shorter = [next((self.rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank), -1) for t in self.tokens]
        self.matcher = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.matcher.add_word(t.decode("latin-1"), i)
        self.matcher.make_automaton()
        # decoding: one run of bytes and an offset for every id
        size = max([*ids.values(), *self.special.values()]) + 1
        by_id = [b""] * size
        for t, i in zip(self.tokens, self.ids):
            by_id[i] = t
        for t, i in self.special.items():
            by_id[i] = t.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in by_id])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """True if merging the bytes of left and right one rank at a time keeps the border between them."""
        bound = len(self.tokens)
        while True:
            if self.pairs.get((left, right), bound) < bound:
                return False
            if left > right:
                bound, left = left, self.parts[left][1]
                if left == bound:
                    bound, right = right + 1, self.parts[right][0]
                    if right + 1 == bound:
                        return True
            else:
                bound, right = right + 1, self.parts[right][0]
                if right + 1 == bound:
                    bound, left = left, self.parts[left][1]
                    if left == bound:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ranks of one piece: longest matches from the left, shortened or taken back where a border is not compatible."""
        longest = [-1] * len(piece)
        sizes = self.tokens
        for end, token in self.matcher.iter(piece.decode("latin-1")):
            start = end + 1 - len(sizes[token])
            if longest[start] < 0 or len(sizes[token]) > len(sizes[longest[start]]):
                longest[start] = token
        out: list[int] = []
        dead = bytearray(len(piece) + 1)
        at, token = 0, longest[0] if piece else -1
        while at < len(piece):
            while token >= 0:
                end = at + len(sizes[token])
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at, token = end, longest[end] if end < len(piece) else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= len(sizes[token])
                token = self.shorter[token]
        return out


class Encoder:
    """Encodes whole texts; remembers pieces."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.memory: dict[str, bytes] = {}
        self.pieces = regex.compile(PIECES)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.vocabulary.special)) + ")") if self.vocabulary.special else None

    def _piece(self, piece: str) -> bytes:
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        v = self.vocabulary
        found = v.ids[v.encode_piece(piece.encode())].tobytes()
        if len(piece) <= 64:
            self.memory[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as packed 32-bit integers."""
        parts = self.special.split(text) if self.special else [text]
        out, known = [], self.memory.get
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.int32(self.vocabulary.special[part]).tobytes())
            elif part:
                out += [known(p) or self._piece(p) for p in self.pieces.findall(part)]
        return b"".join(out)

    def decode(self, ids: np.ndarray, row_ends: np.ndarray) -> pa.Array:
        """Texts of consecutive rows of ids. Bytes that are no UTF-8 become replacement characters, row by row."""
        v = self.vocabulary
        start, size = v.offsets[ids], v.offsets[ids + 1] - v.offsets[ids]
        end = np.cumsum(size)
        data = v.blob[np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)].tobytes()
        stops = np.concatenate([[0], end])[row_ends]
        return pa.array([data[a:z].decode(errors="replace") for a, z in zip(np.concatenate([[0], stops[:-1]]), stops)], pa.string())


@held
def encoder(path: str) -> Encoder:
    return Encoder(path)


def packed_lists(rows: list[bytes]) -> pa.Array:
    """Packed 32-bit integers of each row as a list column."""
    ends = np.cumsum([0] + [len(r) // 4 for r in rows])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.record_batch([part.column("row"), packed_lists([e.encode(t) for t in part.column("_t").to_pylist()])], names=["row", "ids"])
    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = part.column("ids").fill_null([])
                flat = np.asarray(ids.flatten(), dtype=np.int64)
                ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
                yield pa.record_batch([part.column("row"), ids, e.decode(flat, ends)], names=["row", "ids", "decoded"])
    return run


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """row (all columns of docs) and ids. A null text has no ids; an added token's string in a text becomes its id."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole(text_col).alias("_t"))
    return rows.mapInArrow(_encode(path), f"row {docs.schema.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns row and ids and the decoded text; null ids give an empty text."""
    return encoded.select("row", "ids").mapInArrow(_decode(path), f"row {encoded.schema['row'].dataType.simpleString()}, ids array<int>, decoded string")


def joined(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    docs = table(spark, sf_dir, "documents")
    coded = encode(docs.select("doc_id", "text"), path)
    slim = coded.select(F.struct("row.doc_id").alias("row"), "ids")
    return decode(slim, path).select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined(F.col("ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
