"""Queries on time series, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import quality_bucket, r6
from ..operators import long_series as L
from ..operators import resampling as R
from ..operators import timeseries as T
from .views import seconds, series, table

SERIES = """timed AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6::DOUBLE AS a, value AS v FROM events),
series AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY a, event_id) AS frame, a - min(a) OVER (PARTITION BY user_id) AS t, v FROM timed)"""
STEP = 3600.0
RATE = 1 / 21600.0
#: Participants, each with the recordings of several users; replicates of the drift's mean.
PARTICIPANTS, DRIFT_REPS = 20, 2000


def strict_time_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows more than an hour after the one before, with the step to it."""
    s = T.strictly_increasing(series(spark, sf_dir), "user_id", "frame", "t", STEP)
    return s.select("user_id", "frame", r6("t").alias("t"), r6(F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("frame"))).alias("step"))


def gradient_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.strictly_increasing(series(spark, sf_dir), "user_id", "frame", "t", STEP).withColumn("h", F.col("t") / STEP)
    return s.select("user_id", "frame", r6(T.gradient(["user_id"], "frame", "h", "v")).alias("slope"))


def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh value, and the first and last of some users, are taken out and filled."""
    s = series(spark, sf_dir).withColumn("g", F.when((F.col("frame") % 7 != 1), F.col("v")))
    return s.select("user_id", "frame", r6(T.fill_gaps(["user_id"], "frame", "g")).alias("filled"))


def interval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.interval_stats(series(spark, sf_dir), "user_id", "frame", "t", 86400.0)
    return out.select(*(F.col(c) if c in ("user_id", "n", "dropped", "nonpositive") else r6(c).alias(c) for c in out.columns))


def uniform_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values every six hours."""
    return T.uniform_resample(series(spark, sf_dir), "user_id", RATE).select("user_id", "i", r6("v").alias("v"))


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series: k, frame, t (seconds since the first), v."""
    ev = table(spark, sf_dir, "events").select(F.lit(0).alias("k"), "event_id", seconds(F.col("ts")).alias("a"), F.col("value").alias("v"))
    s = L.chunked(ev, "k", ["a", "event_id"])
    first = ev.groupBy("k").agg(F.min("a").alias("first"))
    return s.join(F.broadcast(first), "k").select("k", (F.col("pos") + 1).alias("frame"), (F.col("a") - F.col("first")).alias("t"), "v")


#: Rows of a chunk of the one series: small beside the table, so that the queries go over many chunks.
PART = 1000


def long_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.strictly_increasing(whole(spark, sf_dir), "k", "frame", "t", 1.0, PART).withColumn("h", F.col("t") / STEP)
    return L.with_gradient(s, "k", "frame", "h", "v", "slope", PART).select("frame", r6("slope").alias("slope"))


def long_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of up to five chunks."""
    s = whole(spark, sf_dir).withColumn("g", F.when((F.col("frame") % 7 != 1) & ~F.col("frame").between(1500, 6500), F.col("v")))
    return L.with_filled(s, "k", "frame", "g", "filled", PART).select("frame", r6("filled").alias("filled"))


def long_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one series every half hour."""
    return L.uniform_resample(whole(spark, sf_dir), "k", 1 / 1800.0, size=PART, order="frame").select("i", r6("v").alias("v"))


def long_lowpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one series on its grid, filtered forward and backward at a tenth of the grid's rate."""
    s = L.uniform_resample(whole(spark, sf_dir), "k", 1 / 1800.0, size=PART, order="frame")
    return L.lowpass(s, "k", "i", ["v"], 0.1 / 1800.0, 1 / 1800.0, PART).select(F.col("pos").alias("i"), r6("v").alias("v"))


def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event nearest to each noon of a user's time, a day away at most."""
    s = series(spark, sf_dir)
    last = s.groupBy("user_id").agg(F.max("t").alias("end"))
    days = last.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("end") / 86400.0))).alias("target_id"))
    out = T.nearest(days.withColumn("target_t", F.col("target_id") * 86400.0 + 43200.0), s, "user_id", 86400.0)
    return out.select("user_id", "target_id", "frame", r6("gap").alias("gap"))


def boundary_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over blocks of ten frames moved by up to two."""
    s = series(spark, sf_dir)
    bounds = s.filter(F.col("frame") % 10 == 1).select("user_id", F.col("frame").alias("start"), (F.col("frame") + 9).alias("stop"))
    out = T.boundary_shifts(s, bounds, "user_id", range(-2, 3), 8)
    return out.select("user_id", "start", "shift", "n", r6("mean").alias("mean"))


def _two_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, i, q, k): clicks and views on one grid of twelve hours, over the time that both cover."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", seconds(F.col("ts")).alias("t"), F.col("value").alias("v"))
    q, k = (ev.filter(F.col("event_type") == e).groupBy("user_id", "t").agg(F.avg("v").alias("v")) for e in ("click", "view"))
    span = lambda df, n: df.groupBy("user_id").agg(F.min("t").alias(f"lo{n}"), F.max("t").alias(f"hi{n}"))
    both = span(q, 1).join(span(k, 2), "user_id").select("user_id", F.greatest("lo1", "lo2").alias("lo"), F.least("hi1", "hi2").alias("hi")).filter("hi > lo")
    grid = both.select("user_id", "lo", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / 43200.0))).alias("i"))
    grid = grid.select("user_id", "i", (F.col("lo") + F.col("i") * 43200.0).alias("t"))
    a, b = T.interpolate(q, grid, "user_id"), T.interpolate(k, grid, "user_id")
    return a.select("user_id", "i", F.col("v").alias("q")).join(b.select("user_id", "i", F.col("v").alias("k")), ["user_id", "i"])


WINDOWS = (3, 6)


def overlap_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best lag per user and search window; a delayed k gives a negative lag."""
    best = T.best_lags(T.overlap_correlations(_two_signal(spark, sf_dir), "user_id", range(-6, 7)), "user_id", WINDOWS)
    return best.select("user_id", "window", "lag", r6("r").alias("r"), "on_edge")


def lag_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags per window: spread, share on the edge, and how good the correlations are."""
    best = T.best_lags(T.overlap_correlations(_two_signal(spark, sf_dir), "user_id", range(-6, 7)), "user_id", WINDOWS).withColumn("quality", quality_bucket("r"))
    share = lambda c: r6(100 * F.avg(F.when(c, 1.0).otherwise(0.0)))
    q = lambda p: F.percentile("lag", F.lit(p))
    return best.groupBy("window").agg(
        F.count(F.lit(1)).alias("n"), r6(q(0.5)).alias("median"), r6(q(0.75) - q(0.25)).alias("iqr"), r6(F.percentile(F.abs("lag"), F.lit(0.5))).alias("median_abs"),
        share(F.col("on_edge")).alias("edge_percent"), *(share(F.col("quality") == b).alias(b) for b in ("poor", "weak", "moderate", "good")),
    )


def lag_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute difference of the two signals before and after moving k by a trusted lag."""
    two = _two_signal(spark, sf_dir)
    best = T.best_lags(T.overlap_correlations(two, "user_id", range(-6, 7)), "user_id", (6,))
    good = best.filter((F.col("r") >= 0.2) & ~F.col("on_edge")).select("user_id", "lag")
    moved = two.select("user_id", "k", "i").join(good, "user_id").select("user_id", (F.col("i") + F.col("lag")).alias("i"), F.col("k").alias("k2"), "lag")
    j = two.join(moved, ["user_id", "i"])
    return j.groupBy("user_id", "lag").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs(F.col("q") - F.col("k")))).alias("before"), r6(F.avg(F.abs(F.col("q") - F.col("k2")))).alias("after")).filter("n >= 8")


def clock_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's values against days since the start."""
    out = T.drift(series(spark, sf_dir).withColumn("day", F.col("t") / 86400.0), ["user_id"], "day", "v")
    return out.select("user_id", "n", *(r6(c).alias(c) for c in ("slope", "intercept", "r", "slope_se")))


def drift_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of participants' mean drifts, a user being a recording of a participant, with its percentile interval over
    participants drawn with replacement. Recordings without a slope don't count, nor do participants without recordings."""
    slopes = T.drift(series(spark, sf_dir).withColumn("day", F.col("t") / 86400.0), ["user_id"], "day", "v").dropna(subset=["slope"])
    means = slopes.groupBy(F.pmod("user_id", F.lit(PARTICIPANTS)).alias("participant")).agg(F.avg("slope").alias("m"))
    draw = (F.col("rep") * 7919 + F.col("slot") * 104729 + F.col("rep") * F.col("slot") * 31).cast("long")
    again = means.join(R.drawn_weights(means, "participant", DRIFT_REPS, draw), "participant").groupBy("rep").agg((F.sum(F.col("m") * F.col("w")) / F.sum("w")).alias("mean"))
    whole = means.groupBy(F.lit(-1).alias("rep")).agg(F.avg("m").alias("mean"))
    drawn = F.when(F.col("rep") >= 0, F.col("mean"))
    q = lambda p, n: r6(F.percentile(drawn, F.lit(p))).alias(n)
    return again.unionByName(whole).agg(r6(F.max(F.when(F.col("rep") < 0, F.col("mean")))).alias("mean"), F.count(drawn).alias("reps"), q(0.025, "low"), q(0.975, "high"))


_STRICT = f"kept AS (SELECT * FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY frame) AS b FROM series) WHERE b IS NULL OR t - b > {STEP})"
_TWO = """raw AS (SELECT user_id, event_type, epoch_us(ts) / 1e6::DOUBLE AS t, avg(value) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL),
span AS (SELECT user_id, event_type, min(t) AS lo, max(t) AS hi FROM raw GROUP BY ALL),
common AS (SELECT user_id, max(lo) AS lo, min(hi) AS hi FROM span GROUP BY 1 HAVING count(*) = 2 AND min(hi) > max(lo)),
grid AS (SELECT user_id, i, lo + i * 43200.0::DOUBLE AS t FROM (SELECT user_id, lo, unnest(range(0, floor((hi - lo) / 43200)::BIGINT + 1)) AS i FROM common)),
prev AS (SELECT g.user_id, g.i, g.t, r.event_type, max_by(r.v, r.t) AS va, max(r.t) AS ta FROM grid g JOIN raw r ON r.user_id = g.user_id AND r.t <= g.t GROUP BY ALL),
nxt AS (SELECT g.user_id, g.i, r.event_type, min_by(r.v, r.t) AS vb, min(r.t) AS tb FROM grid g JOIN raw r ON r.user_id = g.user_id AND r.t >= g.t GROUP BY ALL),
val AS (SELECT user_id, i, event_type, CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR tb = ta THEN va ELSE va + (vb - va) * (p.t - ta) / (tb - ta) END AS v FROM prev p FULL JOIN nxt USING (user_id, i, event_type)),
two AS (SELECT a.user_id, a.i, a.v AS q, b.v AS k FROM val a JOIN val b ON a.user_id = b.user_id AND a.i = b.i AND a.event_type = 'click' AND b.event_type = 'view'),
cor AS (SELECT a.user_id, l AS lag, count(*) AS n, covar_pop(a.q, b.k) AS c, sqrt(var_pop(a.q) * var_pop(b.k)) AS s FROM two a CROSS JOIN range(-6, 7) AS x(l) JOIN two b ON a.user_id = b.user_id AND b.i = a.i - l GROUP BY ALL),
good AS (SELECT user_id, lag, c / s AS r FROM cor WHERE n >= 8 AND s * n > 1e-12),
searched AS (SELECT DISTINCT user_id, "window" FROM cor, (VALUES (3), (6)) AS w("window") WHERE abs(lag) <= "window"),
most AS (SELECT user_id, "window", lag, r FROM (SELECT *, row_number() OVER (PARTITION BY user_id, "window" ORDER BY r DESC, lag) AS k FROM good, (VALUES (3), (6)) AS w("window") WHERE abs(lag) <= "window") WHERE k = 1),
best AS (SELECT user_id, "window", lag, r, coalesce(abs(lag) = "window", false) AS on_edge FROM searched LEFT JOIN most USING (user_id, "window"))"""
_Q = lambda c: f"round({c}, 6) + 0.0"
_WHOLE = "s AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS frame, epoch_us(ts) / 1e6::DOUBLE - min(epoch_us(ts) / 1e6::DOUBLE) OVER () AS t, value AS v FROM events)"
SQL = {
    "long_gradient": f"""WITH {_WHOLE}, k AS (SELECT frame, t, v FROM (SELECT *, lag(t) OVER (ORDER BY frame) AS b FROM s) WHERE b IS NULL OR t - b > 1),
 n AS (SELECT frame, t / {STEP} AS h, v, lag(t / {STEP}) OVER w AS h0, lag(v) OVER w AS v0, lead(t / {STEP}) OVER w AS h1, lead(v) OVER w AS v1 FROM k WINDOW w AS (ORDER BY frame))
 SELECT frame, round(CASE WHEN h0 IS NULL AND h1 IS NULL THEN 0 WHEN h0 IS NULL THEN (v1 - v) / (h1 - h) WHEN h1 IS NULL THEN (v - v0) / (h - h0)
 ELSE (pow(h - h0, 2) * v1 + (pow(h1 - h, 2) - pow(h - h0, 2)) * v - pow(h1 - h, 2) * v0) / ((h - h0) * (h1 - h) * (h1 - h0)) END, 6) + 0.0 AS slope FROM n""",
    "long_gap_fill": f"""WITH {_WHOLE}, g AS (SELECT frame, CASE WHEN frame % 7 <> 1 AND NOT frame BETWEEN 1500 AND 6500 THEN v END AS g FROM s),
 f AS (SELECT g.*, a.frame AS i, a.g AS x, b.frame AS j, b.g AS y FROM g ASOF LEFT JOIN (SELECT * FROM g WHERE g IS NOT NULL) a ON a.frame <= g.frame ASOF LEFT JOIN (SELECT * FROM g WHERE g IS NOT NULL) b ON b.frame >= g.frame)
 SELECT frame, round(coalesce(g, x + (y - x) * (frame - i) / nullif(j - i, 0), x, y, 0), 6) + 0.0 AS filled FROM f""",
    "long_resample": f"""WITH {_WHOLE}, u AS (SELECT t, v FROM (SELECT *, lag(t) OVER (ORDER BY frame) AS b FROM s) WHERE b IS NULL OR t - b > 1e-9), e AS (SELECT max(t) AS hi, floor(max(t) / 1800)::BIGINT AS k FROM u),
 grid AS (SELECT i, i * 1800.0::DOUBLE AS t FROM (SELECT unnest(range(0, k + 1 + CASE WHEN hi - k * 1800 > 900 THEN 1 ELSE 0 END)) AS i FROM e)),
 p AS (SELECT i, g.t, a.t AS ta, a.v AS va, b.t AS tb, b.v AS vb FROM grid g ASOF LEFT JOIN u a ON a.t <= g.t ASOF LEFT JOIN u b ON b.t >= g.t)
 SELECT i, round(CASE WHEN tb IS NULL OR tb = ta THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END, 6) + 0.0 AS v FROM p""",
    "strict_time_filter": f"WITH {SERIES}, {_STRICT} SELECT user_id, frame, round(t, 6) + 0.0 AS t, round(t - lag(t) OVER (PARTITION BY user_id ORDER BY frame), 6) + 0.0 AS step FROM kept",
    "gradient_series": f"""WITH {SERIES}, {_STRICT}, n AS (SELECT user_id, frame, t / {STEP} AS h, v, lag(t / {STEP}) OVER w AS h0, lag(v) OVER w AS v0, lead(t / {STEP}) OVER w AS h1, lead(v) OVER w AS v1 FROM kept WINDOW w AS (PARTITION BY user_id ORDER BY frame))
 SELECT user_id, frame, round(CASE WHEN h0 IS NULL AND h1 IS NULL THEN 0 WHEN h0 IS NULL THEN (v1 - v) / (h1 - h) WHEN h1 IS NULL THEN (v - v0) / (h - h0)
 ELSE (pow(h - h0, 2) * v1 + (pow(h1 - h, 2) - pow(h - h0, 2)) * v - pow(h1 - h, 2) * v0) / ((h - h0) * (h1 - h) * (h1 - h0)) END, 6) + 0.0 AS slope FROM n""",
    "gap_fill": f"""WITH {SERIES}, g AS (SELECT user_id, frame, CASE WHEN frame % 7 <> 1 THEN v END AS g FROM series),
 f AS (SELECT *, last_value(g IGNORE NULLS) OVER p AS a, first_value(g IGNORE NULLS) OVER n AS b, last_value(CASE WHEN g IS NOT NULL THEN frame END IGNORE NULLS) OVER p AS i, first_value(CASE WHEN g IS NOT NULL THEN frame END IGNORE NULLS) OVER n AS j FROM g
 WINDOW p AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT user_id, frame, round(coalesce(g, a + (b - a) * (frame - i) / nullif(j - i, 0), a, b, 0), 6) + 0.0 AS filled FROM f""",
    "interval_stats": f"""WITH {SERIES}, d AS (SELECT * FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY frame) AS d FROM series) WHERE d IS NOT NULL), g AS (SELECT user_id, d, CASE WHEN d > 0 THEN d END AS p FROM d)
 SELECT user_id, count(p)::BIGINT AS n, {_Q('avg(p)')} AS mean, {_Q('stddev_samp(p)')} AS sd, {_Q('quantile_cont(p, 0.5)')} AS median, {_Q('quantile_cont(p, 0.75) - quantile_cont(p, 0.25)')} AS iqr, {_Q('quantile_cont(p, 0.99)')} AS p99,
 {_Q('min(p)')} AS least, {_Q('max(p)')} AS most, {_Q('1 / avg(p)')} AS rate, count(*) FILTER (p > 86400)::BIGINT AS dropped, count(*) FILTER (d <= 0)::BIGINT AS nonpositive FROM g GROUP BY user_id""",
    "uniform_resample": f"""WITH {SERIES}, u AS (SELECT user_id, t, v FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS b FROM series) WHERE b IS NULL OR t - b > 1e-9), e AS (SELECT user_id, max(t) AS hi FROM u GROUP BY 1),
 m AS (SELECT user_id, floor(hi / 21600)::BIGINT AS k, hi FROM e), grid AS (SELECT user_id, i, i * 21600.0::DOUBLE AS t FROM (SELECT user_id, unnest(range(0, k + 1 + CASE WHEN hi - k * 21600 > 10800 THEN 1 ELSE 0 END)) AS i FROM m)),
 p AS (SELECT g.user_id, g.i, g.t, max_by(u.v, u.t) AS va, max(u.t) AS ta FROM grid g JOIN u ON u.user_id = g.user_id AND u.t <= g.t GROUP BY ALL),
 n AS (SELECT g.user_id, g.i, min_by(u.v, u.t) AS vb, min(u.t) AS tb FROM grid g JOIN u ON u.user_id = g.user_id AND u.t >= g.t GROUP BY ALL)
 SELECT user_id, i, round(CASE WHEN tb IS NULL OR tb = ta THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END, 6) + 0.0 AS v FROM p LEFT JOIN n USING (user_id, i)""",
    "asof_nearest": f"""WITH {SERIES}, d AS (SELECT user_id, unnest(range(0, floor(max(t) / 86400)::BIGINT + 1)) AS target_id FROM series GROUP BY user_id),
 c AS (SELECT s.user_id, target_id, frame, abs(t - (target_id * 86400 + 43200)) AS gap FROM d JOIN series s USING (user_id) WHERE abs(t - (target_id * 86400 + 43200)) <= 86400)
 SELECT user_id, target_id, frame, round(gap, 6) + 0.0 AS gap FROM (SELECT *, row_number() OVER (PARTITION BY user_id, target_id ORDER BY gap, frame) AS k FROM c) WHERE k = 1""",
    "boundary_shift": f"""WITH {SERIES}, e AS (SELECT user_id, min(frame) AS lo, max(frame) AS hi FROM series GROUP BY 1),
 b AS (SELECT user_id, frame AS start, x::INTEGER AS shift, greatest(frame + x, lo) AS a, least(frame + 9 + x, hi) AS z FROM series JOIN e USING (user_id), range(-2, 3) AS r(x) WHERE frame % 10 = 1)
 SELECT b.user_id, b.start, b.shift, count(*)::BIGINT AS n, round(avg(v), 6) + 0.0 AS mean FROM b JOIN series s ON s.user_id = b.user_id AND s.frame BETWEEN a AND z GROUP BY ALL HAVING count(*) >= 8""",
    "overlap_lag": f'WITH {_TWO} SELECT user_id, "window", lag::INTEGER AS lag, round(r, 6) + 0.0 AS r, on_edge FROM best',
    "lag_quality_summary": f"""WITH {_TWO}, q AS (SELECT *, CASE WHEN r < 0.2 THEN 'poor' WHEN r < 0.3 THEN 'weak' WHEN r < 0.5 THEN 'moderate' ELSE 'good' END AS quality FROM best)
 SELECT "window", count(*)::BIGINT AS n, {_Q('quantile_cont(lag, 0.5)')} AS median, {_Q('quantile_cont(lag, 0.75) - quantile_cont(lag, 0.25)')} AS iqr, {_Q('quantile_cont(abs(lag), 0.5)')} AS median_abs,
 {_Q('100 * avg(on_edge::INT)')} AS edge_percent, {", ".join(f"{_Q(f'100 * avg((quality = {chr(39)}{b}{chr(39)})::INT)')} AS {b}" for b in ('poor', 'weak', 'moderate', 'good'))} FROM q GROUP BY 1""",
    "lag_corrected": f"""WITH {_TWO}, ok AS (SELECT user_id, lag FROM best WHERE "window" = 6 AND r >= 0.2 AND NOT on_edge), mv AS (SELECT user_id, i + lag AS i, k AS k2, lag FROM two JOIN ok USING (user_id))
 SELECT user_id, lag::INTEGER AS lag, count(*)::BIGINT AS n, round(avg(abs(q - k)), 6) + 0.0 AS before, round(avg(abs(q - k2)), 6) + 0.0 AS after FROM two JOIN mv USING (user_id, i) GROUP BY ALL HAVING count(*) >= 8""",
    "clock_drift": f"""WITH {SERIES}, d AS (SELECT user_id, t / 86400 AS x, v AS y FROM series), m AS (SELECT user_id, count(*)::BIGINT AS n, count(DISTINCT x) AS k, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(x, y) AS r, var_samp(x) AS vx, var_samp(y) AS vy FROM d GROUP BY 1)
 SELECT user_id, n, {_Q('slope')} AS slope, {_Q('intercept')} AS intercept, {_Q('r')} AS r, {_Q('sqrt(greatest(0, 1 - r * r) * vy / (vx * (n - 2)))')} AS slope_se FROM m WHERE n >= 3 AND k >= 2""",
    "drift_bootstrap": f"""WITH {SERIES}, d AS (SELECT user_id, t / 86400 AS x, v AS y FROM series), m AS (SELECT user_id, count(*) AS n, count(DISTINCT x) AS k, regr_slope(y, x) AS slope FROM d GROUP BY 1),
 p AS (SELECT user_id % {PARTICIPANTS} AS participant, avg(slope) AS m FROM m WHERE n >= 3 AND k >= 2 GROUP BY 1), who AS (SELECT m, row_number() OVER (ORDER BY participant) - 1 AS i, count(*) OVER () AS k FROM p),
 slots AS (SELECT rep, slot FROM range(0, {DRIFT_REPS}) AS r(rep), range(0, (SELECT count(*) FROM who)) AS s(slot)), again AS (SELECT rep, avg(m) AS mean FROM slots JOIN who ON i = (rep * 7919 + slot * 104729 + rep * slot * 31) % k GROUP BY 1)
 SELECT (SELECT {_Q('avg(m)')} FROM p) AS mean, count(*)::BIGINT AS reps, {_Q('quantile_cont(mean, 0.025)')} AS low, {_Q('quantile_cont(mean, 0.975)')} AS high FROM again""",
}
QUERIES = {f.__name__: f for f in (strict_time_filter, gradient_series, gap_fill, interval_stats, uniform_resample, asof_nearest, boundary_shift, overlap_lag, lag_quality_summary, lag_corrected, clock_drift, drift_bootstrap, long_gradient, long_gap_fill, long_resample, long_lowpass)}
