"""Helpers that several operators share."""
from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staging_path

SPACES = r"[\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, once a session, as spark-submit --py-files would."""
    context = spark.sparkContext
    if not getattr(context, "_reeltide_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="reeltide-"), "reeltide.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, files in os.walk(root):
                for name in files:
                    if name.endswith(".py"):
                        out.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(root)))
        context.addPyFile(path)
        context._reeltide_shipped = True
    return spark


_held: list = []


def forget() -> None:
    """Drop what this process remembers for held functions, and give free Arrow memory back."""
    while _held:
        _held.pop().cache_clear()
    pa.default_memory_pool().release_unused()


def held(make: Callable) -> Callable:
    """make, whose result a worker remembers until it is asked for that of another held function, or told to forget.

    Spark hands one Python worker from stage to stage; the tables of one operator must not stay beside those of the next.
    """
    memo = lru_cache(maxsize=1)(make)

    @wraps(make)
    def ask(*arguments):
        if _held != [memo]:
            forget()
            _held.append(memo)
        return memo(*arguments)
    return ask


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Words between blanks (space, tab, line feed, vertical tab, form feed, carriage return)."""
    return F.array_remove(F.split(text, SPACES), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a name inside the lambda is not inlined by the optimizer."""
    return F.transform(F.array(value), body)[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the plan, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint where the counted rows are within the limit, else a plain shuffle join."""
    return F.broadcast(df) if rows <= limit else df
