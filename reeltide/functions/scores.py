"""Score column functions: bands, priorities, audio levels, vectors."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .numbers import clip, col, rnd, total


def confidence_band(p: Column | str) -> Column:
    """struct(probability, band, label, colour) of the clamped probability."""
    v = clip(p, 0, 1)

    def pick(i: int) -> Column:
        out = F.lit(L.CONFIDENCE_BANDS[0][i])
        for row in L.CONFIDENCE_BANDS[1:]:
            out = F.when(v >= row[0], row[i]).otherwise(out)
        return out

    return F.struct(v.alias("probability"), pick(1).alias("band"), pick(2).alias("label"), pick(3).alias("colour"))


def band_from_value(v: Column | str, uncertainty: float, method: str = "heuristic") -> Column:
    x = col(v)
    return F.struct(
        rnd(clip(x, 0, 1), 4).alias("value"), rnd(clip(x - uncertainty, 0, 1), 4).alias("lower"),
        rnd(clip(x + uncertainty, 0, 1), 4).alias("upper"), F.lit(method).alias("method"),
    )


def overall_manipulation(speed, pitch, compression, reverb, robotic, stretch) -> Column:
    parts = [speed, pitch, compression, reverb, robotic, stretch]
    return total([F.coalesce(col(c), F.lit(0.0)) * w for c, w in zip(parts, [0.2, 0.2, 0.15, 0.15, 0.15, 0.15])])


def lufs_to_linear(lufs: Column | str) -> Column:
    return F.pow(F.lit(10.0), col(lufs) / 20.0) + F.lit(1e-8)


def energy(lufs: Column | str, speech: Column | str) -> Column:
    return F.coalesce(clip((col(lufs) + 60) / 60.0, 0, 1), col(speech), F.lit(0.3))


def crawl_priority(views, duration, upload_date, title, likes, tier, as_of: str, rules: dict | None = None,
                   min_duration: float = 5, max_duration: float = 14400) -> Column:
    rules = rules or L.PRIORITY_RULES
    def log10_of(c):
        return F.log10(F.greatest(F.coalesce(col(c), F.lit(0)), F.lit(1)).cast("double"))

    age = F.datediff(F.lit(as_of).cast("date"), col(upload_date))
    recency = F.coalesce(F.greatest(F.lit(0), F.lit(100) - age) * F.lit(rules["weight_recency"]), F.lit(0.0))
    d = F.coalesce(col(duration), F.lit(0)).cast("double")
    penalty = F.when((d != 0) & ((d < min_duration) | (d > max_duration)), 20.0).when(d > 3600, 5.0).otherwise(0.0)
    low = F.lower(F.coalesce(col(title), F.lit("")))
    boost = total([F.when(F.contains(low, F.lit(k.lower())), float(b)).otherwise(0.0)
                   for k, b in rules["keyword_boosts"].items()] or [F.lit(0.0)])
    multiplier = col(tier).cast("double")
    for key, value in rules["tier_multipliers"].items():
        multiplier = F.when(col(tier).cast("string") == key, float(value)).otherwise(multiplier)
    score = log10_of(views) * rules["weight_views"] + recency - penalty + boost + log10_of(likes) * 0.5 + multiplier * 5
    return rnd(F.greatest(score, F.lit(0.0)), 2)


def hours_since(ts: Column | str, as_of: str) -> Column:
    secs = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(col(ts).try_cast("timestamp"))
    return F.coalesce(F.floor(secs / 3600).cast("long"), F.lit(-1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale > 1e-12, dot(a, b) / scale).otherwise(0.0)


def l2_normalize(v: Column | str) -> Column:
    """The vector and its norm are bound as lambda variables, so neither is worked out anew for every component."""
    def scaled(x: Column, n: Column) -> Column:
        return F.transform(x, lambda y: F.when(n > 1e-8, y.cast("double") / n).otherwise(y.cast("double")))

    return F.transform(F.array(col(v)), lambda x: F.transform(F.array(norm(x)), lambda n: scaled(x, n))[0])[0]
