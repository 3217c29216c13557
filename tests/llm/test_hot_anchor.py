"""Windows around one frequent phrase spread over the buckets."""
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from reeltide.llm import scan, substrings


def test_a_hot_phrase_spreads():
    rng = random.Random(3)
    phrase = [f"phrase{i}" for i in range(14)]
    texts = pa.array([" ".join([f"w{rng.random()}" for _ in range(15)] + phrase + [f"w{rng.random()}" for _ in range(15)]) for _ in range(300)])
    bits, buckets = 16, 16
    anchors = np.concatenate([substrings._windows(data, offsets, 20)[4] for _, _, data, offsets in scan.slices(texts)])
    values, counts = np.unique(anchors, return_counts=True)
    hot = values[counts.argmax():counts.argmax() + 1]
    seen = np.zeros(1 << bits >> 6, np.uint64)
    for place in substrings._filter_bits(hot, bits):
        seen[place >> 6] |= np.uint64(1) << (place & 63).astype(np.uint64)
    ids = pa.array(np.arange(len(texts)))
    out = substrings._candidates(20, SimpleNamespace(value=seen), bits, buckets)([pa.record_batch([ids, ids, texts], names=["_id", "_tag", "_t"])])
    sizes = np.zeros(buckets, int)
    for b in out:
        for bucket, h in zip(b.column("bucket").to_pylist(), b.column("hash").to_pylist()):
            sizes[bucket] += len(h) // 8
    print("entries", sizes.sum(), "largest bucket", sizes.max())
    assert sizes.sum() >= 300 and sizes.max() < 0.15 * sizes.sum()
