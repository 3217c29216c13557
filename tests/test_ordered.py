"""Bucketed order helpers against plain windows, whatever the bucket width."""
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reeltide.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(k, i, float(rng.randint(0, 300)), rng.random()) for k in "ab" for i in range(60)] + [("one", 0, 5.0, 0.5)]
    return spark.createDataFrame(data, "k string, id int, t double, v double").repartition(4).cache()


def same(a, b, cols):
    key = lambda df: sorted(map(tuple, df.select(*cols).collect()), key=repr)
    assert key(a) == key(b)


@pytest.mark.parametrize("width", [1, 25, 10_000])
def test_neighbours(rows, width):
    w = Window.partitionBy("k").orderBy("t", "id")
    plain = rows.withColumn("p", F.lag("v").over(w)).withColumn("n", F.lead("v").over(w))
    b = O.time_bucket("t", width)
    got = O.with_neighbours(rows, "k", ["t", "id"], b, ["v"]).select("*", F.col("prev.v").alias("p"), F.col("next.v").alias("n"))
    same(plain, got, ["k", "id", "p", "n"])
    one = O.with_next(O.with_previous(rows, "k", ["t", "id"], b, ["v"]), "k", ["t", "id"], b, ["v"]).select("*", F.col("prev.v").alias("p"), F.col("next.v").alias("n"))
    same(plain, one, ["k", "id", "p", "n"])


@pytest.mark.parametrize("width", [1, 25, 10_000])
def test_position_and_running(rows, width):
    w = Window.partitionBy("k").orderBy("t", "id")
    b = O.time_bucket("t", width)
    plain = rows.withColumn("pos", F.row_number().over(w).cast("long") - 1).withColumn("n", F.count("*").over(Window.partitionBy("k")))
    same(plain, O.with_position(rows, "k", ["t", "id"], b), ["k", "id", "pos", "n"])
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    same(rows.withColumn("m", F.max("v").over(before)), O.with_running(rows, "k", ["t", "id"], b, F.col("v"), "m", "max", inclusive=False), ["k", "id", "m"])
    same(rows.withColumn("m", F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, 0))), O.with_running(rows, "k", ["t", "id"], b, F.col("id"), "m"), ["k", "id", "m"])


@pytest.mark.parametrize("p", [0.0, 0.3, 0.5, 0.85, 1.0])
def test_quantile(rows, p):
    got = {r["k"]: r["q"] for r in O.exact_quantile(rows, "k", "t", p, "q", bins=7).collect()}
    for k in ("a", "b", "one"):
        assert got[k] == pytest.approx(np.percentile([r["t"] for r in rows.filter(F.col("k") == k).collect()], p * 100))


def test_top_n_above_the_group_limit(spark):
    df = spark.range(5000).select(F.lit("hot").alias("k"), "id")
    got = O.top_n_per_key(df, "k", [F.desc("id")], 1500)
    assert got.count() == 1500 and got.agg(F.min("id")).first()[0] == 3500


def test_empty(spark):
    e = spark.createDataFrame([], "k string, id int, t double, v double")
    assert O.with_neighbours(e, "k", ["t", "id"], O.time_bucket("t", 5), ["v"]).count() == 0
    assert O.exact_quantile(e, "k", "t", 0.5, "q").count() == 0
