"""Numeric column helpers."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, digits: int) -> Column:
    """Half-up rounding that is stable under the summation order of a distributed aggregate."""
    scale = float(10**digits)
    return F.floor(col(c) * scale + F.lit(0.500001)).cast("double") / F.lit(scale)


def clip(c: Column | str, low: float, high: float) -> Column:
    """Clamp; null stays null (greatest and least alone would skip it)."""
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def ratio(num: Column | str, den: Column | str, floor: float = 1.0) -> Column:
    """num / max(den, floor)."""
    return col(num) / F.greatest(col(den), F.lit(floor))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def std0(c: Column | str) -> Column:
    """Population deviation, 0 for one value."""
    return F.coalesce(F.stddev_pop(col(c)), F.lit(0.0))


def whole_number_seconds(ts: Column | str) -> Column:
    """Timestamp as seconds with fraction."""
    return F.unix_micros(col(ts)) / F.lit(1e6)
