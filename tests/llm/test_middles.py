"""Fill-in-middle against a plain cut of every text, and the memory of chunks."""
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_check import compare

from pyspark.sql import functions as F
from reeltide.llm import middles, scan


def brute(i, text):
    text, s = text or "", hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(s[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or any(m in text for m in middles.MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, e = text[:a], text[a:z], text[z:]
    return (n, "spm", a, z - a, f"<S>{e}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, z - a, f"<P>{p}<S>{e}<M>{m}")


def test_query_and_sql(llm):
    verdict, count, note = compare(llm, SF, "op13", middles.op13_fill_in_middle, middles.ORACLE)
    assert (verdict, count) == ("ok", 200), note


def test_texts(llm, odd, empty):
    base = "".join(chr(97 + k * 7 % 26) if k % 11 else "é😀日"[k % 3] for k in range(40_000))
    texts = ["<P>", "x<S", "<S>y", "a<P", "<<P>", ">", "é", "😀" * 5000, base, base[500:] + "tail", "x" * 30_000 + "<M>", base[:9000] + "<S>" + base[:9000]]
    frame = llm.createDataFrame([(i, t) for i, t in enumerate(texts * 20)] + [(None, "null id")], "doc_id long, text string")
    got = middles.fill_in_middle(frame).withColumn("back", middles.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == 20 * len(texts) + 1 and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["row"]["doc_id"], r["row"]["text"])
        assert r["back"] == r["row"]["text"]
    kept = middles.fill_in_middle(odd).collect()
    assert len(kept) == odd.count() and sorted(kept[0]["row"].asDict()) == sorted(odd.columns)
    for r in kept:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["row"]["doc_id"], r["row"]["text"])
    assert middles.fill_in_middle(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab<PSM>é日"), max_size=50), max_size=6))
def test_chunks_of_small_texts(texts):
    marks = middles.checked(middles.MARKS)
    draws = np.array([[7, 3, 0, 50]] * len(texts), np.int64).reshape(-1, 4)
    for n, form, first, middle, out in middles.transform(pa.array(texts, pa.string()), draws, marks, 90, 20, middles.ChunkMemory(marks)):
        text = texts.pop(0)
        if not text or any(m in text for m in middles.MARKS):
            assert form == "plain" and out.decode() == text
            continue
        a, z = sorted((7 % (n + 1), 3 % (n + 1)))
        assert (n, form, first, middle, out.decode()) == (len(text), "psm", a, z - a, f"<P>{text[:a]}<S>{text[z:]}<M>{text[a:z]}")


def test_chunks_are_content_defined_and_bounded():
    rng = np.random.default_rng(3)
    body = rng.integers(97, 123, 200_000).astype(np.uint8)
    moved = np.concatenate([rng.integers(97, 123, 777).astype(np.uint8), body])
    ends = [middles.chunk_ends(x, np.array([0, len(x)]))[0] for x in (body, moved, np.zeros(100_000, np.uint8))]
    assert len(set(ends[0]) & set(ends[1] - 777)) > 0.9 * len(ends[0])
    for e, n in zip(ends, (200_000, 200_777, 100_000)):
        size = np.diff([0, *e])
        assert e[-1] == n and size.max() <= middles.MOST_BYTES and (size[:-1] >= middles.LEAST_BYTES).all()


def test_memory_trusts_content_only():
    marks = middles.checked(middles.MARKS)
    memory = middles.ChunkMemory(marks, limit=100)
    assert memory.summary(5, b"abc")[1] == 3 and memory.summary(5, b"abcd")[1] == 4 and memory.hits == 0
    assert memory.summary(5, b"abc")[1] == 3 and memory.hits == 1
    memory.summary(6, b"x" * 99)
    assert memory.held <= 100
    split = [memory.summary(k, x) for k, x in enumerate([b"text <", b"P", b"> more"])]
    assert memory.marks_in(split) and not memory.marks_in(split[:2])


def test_shared_chunks_are_met_again():
    marks = middles.checked(middles.MARKS)
    rng = np.random.default_rng(4)
    shared = bytes(rng.integers(97, 123, 50_000).astype(np.uint8)).decode()
    memory = middles.ChunkMemory(marks)
    list(middles.transform(pa.array([f"{k} " * k + shared for k in range(10)]), np.zeros((10, 4), np.int64), marks, 90, 20, memory))
    assert memory.hits > 250 and scan.slices


def test_marks_must_not_overlap():
    for marks in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("", "b", "c"), ("abc", "b", "d")):
        with pytest.raises(ValueError):
            middles.checked(marks)
