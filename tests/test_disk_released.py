"""Rounds over a graph delete what the round before left."""
import glob
import os
import time

from pyspark.sql import functions as F

from reeltide.operators.components import connected_components
from reeltide.operators.graph import communities
from reeltide.session import cut_lineage, release


def folders(spark):
    return {f for f in glob.glob(spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/rdd-*") if os.path.isdir(f)}


def chain(spark, n):
    return cut_lineage(spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))


def test_rounds_leave_one_checkpoint(spark):
    edges = chain(spark, 500)
    before = folders(spark)
    got = connected_components(edges)
    assert len(folders(spark) - before) == 1
    assert got.select("component").distinct().collect() == [(0,)] and got.count() == 501


def test_released_folder_is_gone_and_others_stay(spark):
    one, other = chain(spark, 10), chain(spark, 20)
    before = folders(spark)
    release(one)
    assert len(before - folders(spark)) == 1 and other.count() == 20


def test_communities_after_release(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y"), ("z", None)], "source string, target string")
    assert {tuple(r) for r in communities(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "z")}


def test_shuffle_files_go_with_the_checkpoint(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert cut_lineage(df).count() == 7 and df.count() == 7
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = root.getAllFiles().size()
    cut_lineage(df)
    for _ in range(50):
        if root.getAllFiles().size() <= before:
            break
        time.sleep(0.1)
    assert root.getAllFiles().size() <= before
