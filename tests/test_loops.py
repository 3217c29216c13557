"""Passages written four times in a row against the pattern they stand for."""
import random
import re
import time

from pyspark.sql import functions as F

from reeltide.functions import text as X

PATTERN = re.compile("([^\n\r\u0085  ]{10,}?)\\1{3,}")


def texts():
    rng = random.Random(6)
    out = ["", "a" * 39, "a" * 40, "ab" * 19 + "a", "ab" * 20, "abc" * 15, "abc" * 16, "go go go go " * 4, "x" * 20 + "\n" + "x" * 20, "0123456789\n" * 5, "é😀日本語ñü¿¡ß" * 4, "é😀日本語ñü¿¡ß" * 3 + "é😀日本語ñü¿¡"]
    for _ in range(400):
        block = "".join(rng.choice("ab c") for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 11, 13, 25])))
        filler = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randrange(30)))
        text = filler() + block * rng.randrange(1, 45 // len(block) + 6) + block[:rng.randrange(len(block) + 1)] + filler()
        out.append(text if rng.random() < 0.7 else text[:len(text) // 2] + "\n" + text[len(text) // 2:])
    return out


def test_loops_are_those_of_the_pattern(spark):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame(rows, "i int, t string")
    got = {r["i"]: r["x"] for r in frame.select("i", X.has_loop("t").alias("x")).collect()}
    assert got == {i: bool(PATTERN.search(t)) for i, t in rows}
    assert 0.2 < sum(got.values()) / len(got) < 0.9


def test_long_texts_take_no_square_time(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    plain = " ".join(word() for _ in range(36_000))[:200_000]
    looped = plain[:100_000] + plain[5_000:25_000] * 4
    frame = spark.createDataFrame([(0, plain), (1, looped)], "i int, t string").repartition(2, "i")
    frame.select(X.has_loop(F.substring("t", 1, 1000))).collect()
    start = time.time()
    got = {r["i"]: r["x"] for r in frame.select("i", X.has_loop("t").alias("x")).collect()}
    assert got == {0: False, 1: True}
    assert time.time() - start < 20
