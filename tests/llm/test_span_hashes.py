"""Hashing words in spans: the same hashes, without arrays that grow with the slice."""
import tracemalloc

import numpy as np
import pyarrow as pa

from reeltide.llm import scan


def _words(texts):
    _, _, data, offsets = next(scan.slices(pa.array(texts)))
    return (data, *scan.word_bounds(data, offsets)[:2])


def test_spans_give_the_hashes_of_the_whole():
    texts = ["a bc " * 70_000, "x" * (scan.HASHED_BYTES + 5), "", "yz a", "tail " * 80_000]
    data, starts, ends = _words(texts)
    assert (ends[-1] - starts[0]) > 2 * scan.HASHED_BYTES
    assert (scan.word_hashes(data, starts, ends) == scan._span_hashes(data, starts, ends)).all()
    assert len(scan.word_hashes(data, starts[:0], ends[:0])) == 0


def test_memory_of_the_hashes_does_not_grow_with_the_slice():
    data, starts, ends = _words(["some words of a text " * 190_000])
    scan.powers.cache_clear()
    tracemalloc.start()
    scan.word_hashes(data, starts, ends)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 40e6 and kept < 20e6, (peak, kept)  # 8 bytes a byte of the slice, several times over, before
