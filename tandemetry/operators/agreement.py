"""Agreement of two instruments in closed form: every metric follows from one pass of moments per group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import over

METRICS = ("n", "icc_a1", "icc_c1", "ccc", "pearson", "mae", "rmse", "bias", "loa_lower", "loa_upper", "prop_slope", "prop_intercept", "prop_r", "prop_se")


def _finite_pair(x: Column, y: Column) -> Column:
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return ok(x) & ok(y)


def moments(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """n, means, variances, covariance and error sums of finite pairs. bias is y - x with x the reference."""
    a, b = F.col(x), F.col(y)
    return pairs.filter(_finite_pair(a, b)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), F.var_samp(a).alias("vx"), F.var_samp(b).alias("vy"),
        F.covar_samp(a, b).alias("cxy"), F.avg(F.abs(b - a)).alias("mae"), F.avg((b - a) * (b - a)).alias("mse"),
    )


def from_moments(m: DataFrame, keys: list[str]) -> DataFrame:
    """The metrics; null where a group is too small or without spread, as the definitions ask."""
    n, vx, vy, c = F.col("n"), F.col("vx"), F.col("vy"), F.col("cxy")
    d = F.col("mx") - F.col("my")
    vd, vm = vx + vy - 2 * c, (vx + vy + 2 * c) / 4
    slope = over((vy - vx) / 2, vm)
    r = over((vy - vx) / 2, F.sqrt(F.greatest(vd, F.lit(0.0)) * F.greatest(vm, F.lit(0.0))))
    se = F.sqrt(over(F.greatest(F.lit(0.0), 1 - r * r) * vd, vm * (n - 2)))
    enough = lambda value, least: F.when(n >= least, value)
    bias, sd = -d, F.sqrt(F.greatest(vd, F.lit(0.0)))
    return m.select(
        *keys, n.alias("n"),
        enough(over(2 * c, vx + vy + d * d - vd / n), 2).alias("icc_a1"), enough(over(2 * c, vx + vy), 2).alias("icc_c1"), enough(over(2 * c, vx + vy + d * d), 2).alias("ccc"),
        enough(over(c, F.sqrt(vx * vy)), 3).alias("pearson"), F.col("mae"), F.sqrt("mse").alias("rmse"), bias.alias("bias"),
        (bias - 1.96 * sd).alias("loa_lower"), (bias + 1.96 * sd).alias("loa_upper"),
        enough(slope, 3).alias("prop_slope"), enough(bias - slope * (F.col("mx") + F.col("my")) / 2, 3).alias("prop_intercept"),
        enough(r, 3).alias("prop_r"), enough(se, 3).alias("prop_se"),
    )


def agreement(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    return from_moments(moments(pairs, keys, x, y), keys)


def beta_regularised(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularised(1 - x, b, a)
    front = exp(a * log(x) + b * log(1 - x) - lgamma(a) - lgamma(b) + lgamma(a + b)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def slope_p_value(metrics: DataFrame) -> DataFrame:
    """Adds prop_p, the two-sided p of the proportional-bias slope; one row per group, so a small Arrow function does it."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([beta_regularised(max(0.0, 1 - q * q), (k - 2) / 2, 0.5) if k > 2 and q == q else None for q, k in zip(r, n)], dtype="float64")

    return metrics.withColumn("prop_p", p("prop_r", "n"))
