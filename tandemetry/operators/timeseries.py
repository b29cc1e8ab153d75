"""Irregular time series as window expressions: differences, gradients, gaps, resampling, as-of and range joins.

A series is the rows of one key (a user, a segment); windows never span keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def strictly_increasing(df: DataFrame, key: str, order: str, t: str, least: float = 1e-9) -> DataFrame:
    """The first row of a series and those whose time exceeds the row before it, kept or not, by more than ``least``."""
    before = F.lag(t).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col(t) - F.col("_before") > least)).drop("_before")


def gradient(key: list[str], order: str, t: str, v: str) -> Column:
    """Second-order differences for unequal steps inside, one-sided at the ends, 0 for a single sample."""
    w = Window.partitionBy(*key).orderBy(order)
    t0, v0, t1, v1 = F.lag(t).over(w), F.lag(v).over(w), F.lead(t).over(w), F.lead(v).over(w)
    hs, hd, f = F.col(t) - t0, t1 - F.col(t), F.col(v)
    inner = (hs * hs * v1 + (hd * hd - hs * hs) * f - hd * hd * v0) / F.nullif(hs * hd * (hs + hd), F.lit(0.0))
    right, left = (v1 - f) / F.nullif(hd, F.lit(0.0)), (f - v0) / F.nullif(hs, F.lit(0.0))
    return F.when(t0.isNull() & t1.isNull(), F.lit(0.0)).when(t0.isNull(), right).when(t1.isNull(), left).otherwise(inner)


def _sides(key: list[str], order: list[str]) -> tuple[WindowSpec, WindowSpec]:
    """The rows up to a row, and those from it on in the opposite order, so that the last of either is the nearest. A frame
    that ends with the partition is gone through anew for each row; one that begins with it only grows."""
    back = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    return tuple(w.rowsBetween(Window.unboundedPreceding, 0) for w in (Window.partitionBy(*key).orderBy(*order), back))


def fill_gaps(key: list[str], order: str, v: str) -> Column:
    """A null becomes the linear interpolation by index between its neighbours, the nearest value at the ends, 0 if there is none."""
    past, future = _sides(key, [order])
    at = F.when(F.col(v).isNotNull(), F.col(order))
    a, b = F.last(v, ignorenulls=True).over(past), F.last(v, ignorenulls=True).over(future)
    i, j = F.last(at, ignorenulls=True).over(past), F.last(at, ignorenulls=True).over(future)
    between = a + (b - a) * (F.col(order) - i) / F.nullif(j - i, F.lit(0)).cast("double")
    return F.coalesce(F.col(v), between, a, b, F.lit(0.0))


def interpolate(knots: DataFrame, grid: DataFrame, key: str, t: str = "t", values: tuple[str, ...] = ("v",)) -> DataFrame:
    """Values at the grid's times, linear between the knots before and after, clamped at the ends: an as-of join in one
    sort in either direction. knots (key, t, values) with increasing times; grid (key, t, i). Grid points of a key without knots go away."""
    rows = knots.select(key, t, F.lit(None).cast("long").alias("i"), F.lit(0).alias("side"), *values)
    wanted = grid.select(key, t, F.col("i").cast("long").alias("i"), F.lit(1).alias("side"), *(F.lit(None).cast("double").alias(v) for v in values))
    past, future = _sides([key], [t, "side"])
    known = F.when(F.col("side") == 0, F.col(t))
    both = rows.unionByName(wanted).select(
        key, t, "i", "side", F.last(known, ignorenulls=True).over(past).alias("_ta"), F.last(known, ignorenulls=True).over(future).alias("_tb"),
        *(F.last(v, ignorenulls=True).over(past).alias(f"_a_{v}") for v in values), *(F.last(v, ignorenulls=True).over(future).alias(f"_b_{v}") for v in values),
    )

    def at(v: str) -> Column:
        a, b, ta, tb = F.col(f"_a_{v}"), F.col(f"_b_{v}"), F.col("_ta"), F.col("_tb")
        return F.when(ta.isNull(), b).when(tb.isNull() | (tb == ta), a).otherwise(a + (b - a) * (F.col(t) - ta) / F.nullif(tb - ta, F.lit(0.0)))

    return both.filter((F.col("side") == 1) & (F.col("_ta").isNotNull() | F.col("_tb").isNotNull())).select(key, "i", t, *(at(v).alias(v) for v in values))


def uniform_grid(series: DataFrame, key: str, rate: float, t: str = "t") -> DataFrame:
    """(key, i, t): floor(end * rate) + 1 points from 0, and one more if over half a step remains."""
    end = series.groupBy(key).agg(F.max(t).alias("end"))
    n = F.floor(F.col("end") * rate)
    n = n + F.when(F.col("end") - n / F.lit(rate) > 0.5 / rate, 1).otherwise(0)
    return end.select(key, F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("i")).withColumn("t", F.col("i") / F.lit(rate))


def uniform_resample(series: DataFrame, key: str, rate: float, t: str = "t", v: str = "v") -> DataFrame:
    """A strictly increasing series on an exact uniform grid."""
    knots = strictly_increasing(series, key, t, t)
    return interpolate(knots, uniform_grid(knots, key, rate, t), key, t, (v,))


def nearest(targets: DataFrame, series: DataFrame, key: str, within: float, t: str = "t", frame: str = "frame") -> DataFrame:
    """The frame nearest to each target, the first on ties. Both sides are cut in cells of ``within``, so it is an equi-join
    on (key, cell) of a target's own and adjoining cells. targets: (key, target_id, target_t)."""
    cell = lambda c: F.floor(c / F.lit(within))
    wanted = targets.select(key, "target_id", "target_t", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: cell(F.col("target_t")) + d)).alias("cell"))
    placed = series.select(key, F.col(t).alias("_t"), F.col(frame).alias("_frame"), cell(F.col(t)).alias("cell"))
    near = wanted.join(placed, [key, "cell"]).withColumn("gap", F.abs(F.col("_t") - F.col("target_t"))).filter(F.col("gap") <= within)
    return near.groupBy(key, "target_id").agg(F.min(F.struct("gap", "_frame")).alias("best")).select(key, "target_id", F.col("best._frame").alias("frame"), F.col("best.gap").alias("gap"))


def boundary_shifts(series: DataFrame, bounds: DataFrame, key: str, shifts: range, least: int, v: str = "v") -> DataFrame:
    """Mean and size of each interval of frames shifted by s and clamped to the series. bounds: (key, start, stop). An
    interval's frames are listed and looked up by equality, so nothing is compared pair by pair."""
    edge = series.groupBy(key).agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    s = bounds.join(edge, key).withColumn("shift", F.explode(F.array(*[F.lit(i) for i in shifts])))
    a, b = F.greatest(F.col("start") + F.col("shift"), F.col("lo")), F.least(F.col("stop") + F.col("shift"), F.col("hi"))
    frames = s.filter(a <= b).select(key, "start", "shift", F.explode(F.sequence(a, b)).alias("frame"))
    out = frames.join(series.select(key, "frame", v), [key, "frame"]).groupBy(key, "start", "shift").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"))
    return out.filter(F.col("n") >= least)


def interval_stats(series: DataFrame, key: str, order: str, t: str, slow: float) -> DataFrame:
    """Statistics of the positive steps of each series; steps of 0 or less are only counted."""
    step = F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(order))
    d = series.select(key, step.alias("d")).filter(F.col("d").isNotNull())
    good = F.when(F.col("d") > 0, F.col("d"))
    q = lambda p: F.percentile(good, F.lit(p))
    return d.groupBy(key).agg(
        F.count(good).alias("n"), F.avg(good).alias("mean"), F.stddev_samp(good).alias("sd"), q(0.5).alias("median"), (q(0.75) - q(0.25)).alias("iqr"),
        q(0.99).alias("p99"), F.min(good).alias("least"), F.max(good).alias("most"), (1 / F.nullif(F.avg(good), F.lit(0.0))).alias("rate"),
        F.count_if(good > slow).alias("dropped"), F.count_if(F.col("d") <= 0).alias("nonpositive"),
    )


def overlap_correlations(two: DataFrame, key: str, lags: range, least: int = 8) -> DataFrame:
    """Pearson correlation of q[i] with k[i - lag] over their overlap, for each lag; null under ``least`` samples or without
    spread. two: (key, i, q, k). A lag is an equi-join on the shifted index. ``noise`` bounds what the order of the rows can
    change in r: it grows with the samples and with the means in units of the spread."""
    q = two.select(key, "i", "q").withColumn("lag", F.explode(F.array(*[F.lit(x) for x in lags])))
    k = two.select(key, F.col("i").alias("j"), "k")
    both = q.withColumn("j", F.col("i") - F.col("lag")).join(k, [key, "j"])
    n = F.count(F.lit(1))
    m = both.groupBy(key, "lag").agg(
        n.alias("n"), F.covar_pop("q", "k").alias("c"), F.var_pop("q").alias("vq"), F.var_pop("k").alias("vk"), F.avg("q").alias("mq"), F.avg("k").alias("mk"),
    )
    spread = F.sqrt(F.col("vq") * F.col("vk"))
    far = lambda c: F.abs(f"m{c}") / F.sqrt(F.nullif(f"v{c}", F.lit(0.0)))
    r = F.when((F.col("n") >= least) & (spread * F.col("n") > 1e-12), F.col("c") / F.nullif(spread, F.lit(0.0)))
    return m.select(key, "lag", "n", r.alias("r"), (F.col("n") * F.lit(2.0**-52) * (4 + far("q") + far("k"))).alias("noise"))


def best_lags(correlations: DataFrame, key: str, windows: tuple[int, ...]) -> DataFrame:
    """Per search window the lag of the largest correlation, the most negative on ties; whether it lies on the window's edge.
    Correlations that their noise doesn't tell apart are ties: two straight lines correlate by 1 at every lag, and which sum
    ends above or below depends on the order of the rows. Without any correlation the row stands with a null lag and r, not on
    the edge."""
    w = correlations.withColumn("window", F.explode(F.array(*[F.lit(x) for x in windows]))).filter(F.abs("lag") <= F.col("window"))
    of = w.groupBy(key, "window").agg(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("lag", "r", "noise"))).alias("of"), F.max(F.col("r") - F.col("noise")).alias("sure"))
    best = of.withColumn("b", F.array_min(F.filter("of", lambda x: x["r"] + x["noise"] >= F.col("sure"))))
    edge = F.coalesce(F.abs("b.lag") == F.col("window"), F.lit(False))
    return best.select(key, "window", F.col("b.lag").alias("lag"), F.col("b.r").alias("r"), edge.alias("on_edge"))


def drift(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares of y on x with the slope's standard error; three points with two different x at least."""
    p = points.dropna(subset=[x, y])
    m = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(x).alias("k"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"))
    se = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("r") * F.col("r")) * F.col("vy") / F.nullif(F.col("vx") * (F.col("n") - 2), F.lit(0.0)))
    return m.filter((F.col("n") >= 3) & (F.col("k") >= 2)).select(*keys, "n", "slope", "intercept", "r", se.alias("slope_se"))
