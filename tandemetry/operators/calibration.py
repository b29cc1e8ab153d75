"""Calibration of one instrument to the other by univariate ridge, without leakage: nested leave-one-participant-out.

Sums per participant are all that is needed: a fold is the total less the held ones, a loss on held rows is a quadratic
form of their sums. Rows are read once, to add up and, at the end, to predict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
_S = ("n", "sx", "sy", "sxx", "syy", "sxy")


def participant_sums(pairs: DataFrame) -> DataFrame:
    """(feature, participant, centres, sums); x is the reference, y what is calibrated. Centred on the feature's means."""
    c = pairs.groupBy("feature").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    p = pairs.join(c, "feature").withColumn("u", F.col("x") - F.col("cx")).withColumn("v", F.col("y") - F.col("cy"))
    return p.groupBy("feature", "participant", "cx", "cy").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("u").alias("sx"), F.sum("v").alias("sy"),
        F.sum(F.col("u") * F.col("u")).alias("sxx"), F.sum(F.col("v") * F.col("v")).alias("syy"), F.sum(F.col("u") * F.col("v")).alias("sxy"),
    )


def _fit(n: Column, sx: Column, sy: Column, syy: Column, sxy: Column, alpha: Column) -> tuple[Column, Column]:
    """(slope, intercept) on centred values: standardise y by its population deviation (1 where there is none), shrink, undo."""
    var = syy / n - sy * sy / (n * n)
    var = F.when(var < 1e-24, 1.0).otherwise(var)
    slope = (sxy - sx * sy / n) / (var * (n + alpha))
    return slope, sx / n - slope * sy / n


def chosen_alphas(sums: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(feature, held, alpha): the smallest mean over inner folds of the RMSE in units of the training deviation of x, the first on ties."""
    w = Window.partitionBy("feature")
    total = sums.select("feature", F.col("participant").alias("held"), *(F.col(c).alias(f"o_{c}") for c in _S), *(F.sum(c).over(w).alias(f"t_{c}") for c in _S))
    inner = sums.select("feature", F.col("participant").alias("out"), *(F.col(c).alias(f"i_{c}") for c in _S))
    f = total.join(inner, "feature").filter(F.col("held") != F.col("out"))  # participants of a study, fold by fold
    n, sx, sy, sxx, syy, sxy = (F.col(f"t_{c}") - F.col(f"o_{c}") - F.col(f"i_{c}") for c in _S)
    f = f.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    b, a = _fit(n, sx, sy, syy, sxy, F.col("alpha"))
    k, ix, iy, ixx, iyy, ixy = (F.col(f"i_{c}") for c in _S)
    loss = ixx + k * a * a + b * b * iyy - 2 * a * ix - 2 * b * ixy + 2 * a * b * iy
    sd = F.sqrt(F.greatest(F.lit(0.0), (sxx - sx * sx / n) / (n - 1)))
    rmse = F.sqrt(F.greatest(F.lit(0.0), loss) / k) / F.when(sd > 0, sd).otherwise(1.0)
    mean = f.groupBy("feature", "held", "alpha").agg(F.avg(rmse).alias("loss"))
    return mean.groupBy("feature", "held").agg(F.min(F.struct(F.round("loss", 9).alias("loss"), "alpha")).alias("best")).select("feature", "held", F.col("best.alpha").alias("alpha"))


def coefficients(sums: DataFrame, alphas: DataFrame) -> DataFrame:
    """(feature, held, alpha, slope, intercept, baseline) fitted without the held participant; baseline is the shift alone."""
    w = Window.partitionBy("feature")
    rest = sums.select("feature", F.col("participant").alias("held"), "cx", "cy", *((F.sum(c).over(w) - F.col(c)).alias(c) for c in _S))
    b, a = _fit(F.col("n"), F.col("sx"), F.col("sy"), F.col("syy"), F.col("sxy"), F.col("alpha"))
    shift = F.col("cx") - F.col("cy") + (F.col("sx") - F.col("sy")) / F.col("n")
    return rest.join(alphas, ["feature", "held"]).select("feature", "held", "alpha", b.alias("slope"), (a + F.col("cx") - b * F.col("cy")).alias("intercept"), shift.alias("shift"))


def out_of_fold(pairs: DataFrame, coefs: DataFrame) -> DataFrame:
    """pairs with y calibrated by ridge and by the shift alone, each row by the model that never saw its participant."""
    c = coefs.withColumnRenamed("held", "participant")
    return pairs.join(c, ["feature", "participant"]).select("feature", "participant", "gesture", "x", "y", (F.col("slope") * F.col("y") + F.col("intercept")).alias("ridge"), (F.col("y") + F.col("shift")).alias("shifted"))
