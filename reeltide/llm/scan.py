"""Array forms of words and window hashes over slices of an Arrow text column (used inside tasks)."""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII that is no letter ends a term.
NO_LETTER = np.zeros(256, bool)
NO_LETTER[:128] = [not chr(i).isalpha() for i in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes hashed at a time (a longer word is hashed alone); the arrays of the work hold eight bytes for each.
HASHED_BYTES = 1 << 18


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[:1] = 1
    return np.cumprod(out)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(n).bit_length())
    return powers(base, size), powers(pow(base, -1, 1 << 64), size)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits, so that comparisons and low bits of a hash are random."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def rolling(x: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hashes of all runs of k values, modulo 2 ** 64."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    p, inverse = _powers(base, len(x) + 1)
    c = np.zeros(len(x) + 1, U)
    np.cumsum(x * p[:len(x)], out=c[1:])
    return (c[k:] - c[:n]) * inverse[:n]


def slices(texts: pa.Array, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of runs of rows; a longer text is a run of its own."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1)
        end = min(end, len(texts))
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every row (with the number of words last)."""
    gap = np.ones(len(data) + 1, bool)
    np.take(ends_word, data, out=gap[:-1])
    first = np.zeros(len(data) + 1, bool)
    inner = offsets[(offsets < len(data))]
    first[inner] = True
    starts = ~gap
    starts[1:] &= gap[:-1] | first[1:]
    starts = np.flatnonzero(starts)
    stop = gap | first
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offsets)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p, inverse = _powers(BASE, len(data) + 1)
    c = np.zeros(len(data) + 1, U)
    np.cumsum(_byte_values()[data] * p[:len(data)], out=c[1:])
    return mix((c[ends] - c[starts]) * inverse[starts] + (ends - starts).astype(U))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes; a hash does not depend on where the word stands, so spans of words are hashed one after the other."""
    out, at = np.zeros(len(starts), U), 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + HASHED_BYTES, side="right")))
        out[at:to] = _span_hashes(data[lo:ends[to - 1]], starts[at:to] - lo, ends[at:to] - lo)
        at = to
    return out
