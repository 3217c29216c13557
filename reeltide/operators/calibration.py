"""Score calibration: one fit per target, applied to score tables as column arithmetic."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.numbers import clip, rnd
from ..functions.scores import confidence_band

PARAMS = ("target string, method string, fitted boolean, samples bigint, a double, b double, temperature double, "
          "boundaries array<double>, predictions array<double>")


def _condensed(samples: DataFrame) -> DataFrame:
    """Equal scores counted once; fits work on these rows, whose number the score resolution bounds."""
    return samples.groupBy(F.col("raw").cast("double").alias("raw")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("truth").cast("double")).alias("pos"))


def fit_platt(samples: DataFrame) -> dict:
    """Slope and intercept of the logistic fit."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    c = _condensed(samples)
    both = c.select("raw", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("pos").alias("w")), F.struct(F.lit(0.0).alias("label"), (F.col("n") - F.col("pos")).alias("w")))).alias("x"))
    rows = both.select(array_to_vector(F.array("raw")).alias("features"), "x.label", "x.w").filter("w > 0")
    m = LogisticRegression(regParam=0.0, weightCol="w", tol=1e-9, maxIter=200, standardization=False).fit(rows)
    return {"a": float(m.coefficients[0]), "b": float(m.intercept)}


def fit_isotonic(samples: DataFrame) -> dict:
    """Boundaries and values of the monotone fit, clipped to [0, 1]."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression
    rows = _condensed(samples).select(array_to_vector(F.array("raw")).alias("features"), (F.col("pos") / F.col("n")).alias("label"), F.col("n").alias("w"))
    m = IsotonicRegression(weightCol="w").fit(rows)
    return {"boundaries": [float(x) for x in m.boundaries.toArray()], "predictions": [min(1.0, max(0.0, float(x))) for x in m.predictions.toArray()]}


def fit_temperature(samples: DataFrame, points: int = 41, rounds: int = 5) -> dict:
    """Temperature in [0.01, 10] with the least log loss: each round tries a grid in one aggregate and narrows it."""
    c = _condensed(samples).persist()
    low, high, best = 0.01, 10.0, 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        p = clip(1 / (1 + F.exp(-F.col("raw") / F.col("t"))), 1e-7, 1 - 1e-7)
        loss = -(F.col("pos") * F.log(p) + (F.col("n") - F.col("pos")) * F.log(1 - p))
        tried = c.withColumn("t", F.explode(F.array(*[F.lit(t) for t in grid]))).groupBy("t").agg(F.sum(loss).alias("loss"))
        best = tried.orderBy("loss", "t").first()["t"]
        step = (high - low) / (points - 1)
        low, high = max(0.01, best - step), min(10.0, best + step)
    c.unpersist()
    return {"temperature": max(best, 0.01)}


FITS = {"platt": fit_platt, "isotonic": fit_isotonic, "temperature": fit_temperature}


def fit_all(samples: DataFrame, min_samples: int = 30, targets: dict[str, str] | None = None) -> DataFrame:
    """Parameter table of all known targets; those with too few samples stay unfitted."""
    targets = targets or L.CALIBRATION_TARGETS
    counts = {r["target"]: r["n"] for r in samples.filter(F.col("target").isin(list(targets))).groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for target, method in targets.items():
        n = counts.get(target, 0)
        got = FITS[method](samples.filter(F.col("target") == target)) if n >= min_samples else {}
        rows.append((target, method, bool(got), n, *[got.get(k) for k in ("a", "b", "temperature", "boundaries", "predictions")]))
    return samples.sparkSession.createDataFrame(rows, PARAMS)


def _interpolate(x):
    """Value of the monotone fit at x, linear between boundaries and flat outside."""
    b, p = F.col("boundaries"), F.col("predictions")
    i = F.size(F.filter(b, lambda v: v <= x))
    lo, hi = F.element_at(b, F.greatest(i, F.lit(1))), F.element_at(b, F.least(i + 1, F.size(b)))
    plo, phi = F.element_at(p, F.greatest(i, F.lit(1))), F.element_at(p, F.least(i + 1, F.size(p)))
    return F.when(i == 0, F.element_at(p, 1)).when((i >= F.size(b)) | (hi <= lo), F.element_at(p, F.greatest(i, F.lit(1)))).otherwise(plo + (phi - plo) * (x - lo) / (hi - lo))


def calibrate(scores: DataFrame, params: DataFrame) -> DataFrame:
    """scores(target, raw, ...) with probability and band; scores of unfitted targets pass through, clamped."""
    j = scores.join(params.drop("samples"), "target", "left")
    x = F.col("raw").cast("double")
    fitted = F.coalesce("fitted", F.lit(False))
    out = F.when(fitted & (F.col("method") == "platt"), 1 / (1 + F.exp(-(F.col("a") * x + F.col("b")))))
    out = out.when(fitted & (F.col("method") == "temperature"), 1 / (1 + F.exp(-x / F.greatest("temperature", F.lit(1e-8)))))
    out = out.when(fitted & (F.col("method") == "isotonic"), _interpolate(x)).otherwise(x)
    band = confidence_band(out)
    return j.withColumn("_c", band).select(*scores.columns, F.col("_c.probability").alias("calibrated_probability"), "_c.band", F.col("_c.label").alias("band_label"), F.col("_c.colour").alias("band_color"))


def calibration_status(params: DataFrame) -> DataFrame:
    return params.select("target", "method", "fitted", F.col("samples").alias("training_samples"))


def confidence_distribution(calibrated: DataFrame) -> DataFrame:
    n = calibrated.groupBy("target").agg(F.count(F.lit(1)).alias("all"))
    return calibrated.groupBy("target", "band").agg(F.count(F.lit(1)).alias("n")).join(n, "target").select("target", "band", "n", rnd(F.col("n") / F.col("all"), 4).alias("share"))


def log_loss(samples: DataFrame, temperature: float) -> float:
    p = clip(1 / (1 + F.exp(-F.col("raw") / temperature)), 1e-7, 1 - 1e-7)
    return samples.agg((-F.avg(F.col("truth") * F.log(p) + (1 - F.col("truth")) * F.log(1 - p))).alias("l")).first()["l"] or math.inf
