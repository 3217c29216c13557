"""Periodic runs against brute force."""
import hashlib
import random
import zlib

import numpy as np
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from reeltide.llm import runs


def brute(w, min_length=6, min_repeats=4):
    """All maximal stretches by trying every period; a stretch with a smaller period is left out."""
    found = set()
    for p in range(1, len(w) // min_repeats + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            own = w[i:j + p]
            if j > i and len(own) >= max(min_length, min_repeats * p) and not any(own[q:] == own[:-q] for q in range(1, p)):
                found.add((i, len(own), p))
            i = max(j, i + 1)
    return sorted(found)


def collapsed(words, spans):
    gone = {k for start, length, period in spans for k in range(start + period, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(6, 4), (2, 2)]))
def test_few_symbols(w, least):
    assert sorted(zip(*(x.tolist() for x in runs.find_runs(np.array(w, np.int64), *least)))) == brute(w, *least)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(2, 30), st.integers(0, 200), st.lists(st.integers(0, 3), max_size=10))
def test_repeated_blocks(block, times, broken, tail):
    w = block * times + tail
    w[broken % len(w)] = 9 if broken % 2 else w[broken % len(w)]
    for least in ((6, 4), (2, 2)):
        assert sorted(zip(*(x.tolist() for x in runs.find_runs(np.array(w, np.int64), *least)))) == brute(w, *least)


def test_long_runs_and_powers():
    for period in (1, 2, 7, 1000):
        w = np.tile(np.arange(period), 40_000 // period)
        assert [x.tolist() for x in runs.find_runs(w)] == [[0], [len(w)], [period]]
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    assert sorted(zip(*(x.tolist() for x in runs.find_runs(np.array(b), 2, 2)))) == brute(b, 2, 2)


def test_query(llm, documents):
    got = {r["doc_id"]: r for r in entry.queries()["op11_periodic_runs"](llm, SF).collect()}
    assert len(got) == len(documents)
    total = 0
    for i, text, _ in documents:
        w = [x.decode() for x in (text or "").encode().split()]
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        spans = brute(w)
        total += len(spans)
        best = max(spans, key=lambda x: (x[1], -x[0], -x[2])) if spans else (None, None, None)
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(spans), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if spans else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in spans).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, spans).encode()).hexdigest()
    assert total > 10


def test_odd(odd, empty):
    got = {r["row"]["row"]: r for r in runs.periodic_runs(odd).collect()}
    assert len(got) == odd.count() and got[0]["row"]["_t"] == "x"
    for r in got.values():
        w = (r["row"]["text"] or "").split()
        if len(w) < 100:
            assert [tuple(x) for x in r["runs"]] == brute(w) and r["collapsed"] == collapsed(w, brute(w))
        assert r["n_words"] == len(w)
    assert got[5]["collapsed"] == "the same words again and again" and [tuple(x) for x in got[7]["runs"]] == [(0, 30_000, 997)]
    assert runs.periodic_runs(empty).count() == 0


def test_slices_hold_together(llm, monkeypatch):
    """Texts side by side in one array and each alone give the same."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(80))) for _ in range(200)]
    frame = llm.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in runs.periodic_runs(frame).collect():
        assert [tuple(x) for x in r["runs"]] == brute(texts[r["row"]["doc_id"]].split())
