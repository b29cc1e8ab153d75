"""Queries on paired measurements, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import agreement as A
from ..operators import resampling as R
from .views import CONDITIONS, FEATURES, obs, paired

LONG = ("n",)
OBS = """obs AS (SELECT s_nationkey AS participant, l_linenumber AS gesture, l_linestatus AS sensor, l_returnflag AS condition, l_quantity AS quantity,
 l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def paired_sql(more: str = "", source: str = "obs", name: str = "paired") -> str:
    keys = f"participant, gesture{more}"
    each = " UNION ALL ".join(f"SELECT {keys}, '{f}' AS feature, avg({f}) FILTER (sensor = 'F') AS x, avg({f}) FILTER (sensor = 'O') AS y FROM {source} GROUP BY {keys}" for f in FEATURES)
    return f"{name} AS (SELECT * FROM ({each}) WHERE x IS NOT NULL AND y IS NOT NULL)"


def metrics_sql(source: str, keys: str, columns: tuple[str, ...] = A.METRICS, name: str = "metrics") -> str:
    return f"""mom_{name} AS (SELECT {keys}, count(*)::BIGINT AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c, avg(abs(y - x)) AS mae,
 avg((y - x) * (y - x)) AS mse FROM {source} GROUP BY {keys}),
 der_{name} AS (SELECT *, vx + vy - 2 * c AS vd, (vx + vy + 2 * c) / 4 AS vm, mx - my AS d FROM mom_{name}),
 {name} AS (SELECT {keys}, n, CASE WHEN n > 1 THEN 2 * c / nullif(vx + vy + d * d - vd / n, 0) END AS icc_a1, CASE WHEN n > 1 THEN 2 * c / nullif(vx + vy, 0) END AS icc_c1,
 CASE WHEN n > 1 THEN 2 * c / nullif(vx + vy + d * d, 0) END AS ccc, CASE WHEN n > 2 THEN c / nullif(sqrt(vx * vy), 0) END AS pearson, mae, sqrt(mse) AS rmse, -d AS bias,
 -d - 1.96::DOUBLE * sqrt(vd) AS loa_lower, -d + 1.96::DOUBLE * sqrt(vd) AS loa_upper, CASE WHEN n > 2 THEN (vy - vx) / 2 / nullif(vm, 0) END AS prop_slope,
 CASE WHEN n > 2 THEN -d - (vy - vx) / 2 / nullif(vm, 0) * (mx + my) / 2 END AS prop_intercept, CASE WHEN n > 2 THEN (vy - vx) / 2 / nullif(sqrt(vd * vm), 0) END AS prop_r,
 CASE WHEN n > 2 THEN sqrt(greatest(0, 1 - pow((vy - vx) / 2 / nullif(sqrt(vd * vm), 0), 2)) * vd / nullif(vm * (n - 2), 0)) END AS prop_se FROM der_{name})"""


def show(df: DataFrame, keys: list[str], columns: tuple[str, ...] = A.METRICS) -> DataFrame:
    return df.select(*keys, *(F.col(c) if c in LONG else r6(c).alias(c) for c in columns))


def show_sql(columns: tuple[str, ...] = A.METRICS) -> str:
    return ", ".join(c if c in LONG else f"round({c}, 6) + 0.0 AS {c}" for c in columns)


def agreement_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement per feature over participant and gesture means."""
    return show(A.agreement(paired(obs(spark, sf_dir)), ["feature"]), ["feature"])


def agreement_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(A.agreement(paired(obs(spark, sf_dir), "condition"), ["condition", "feature"]), ["condition", "feature"])


def agreement_gesture_wise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show(A.agreement(paired(obs(spark, sf_dir)), ["gesture", "feature"]), ["gesture", "feature"])


STATIC = (1, 2, 3)


def agreement_static_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    still = obs(spark, sf_dir).filter(F.col("gesture").isin(*STATIC))
    return show(A.agreement(paired(still), ["feature"]), ["feature"])


UNITS = {"quantity": ("count", 1.0), "extendedprice": ("thousandth", 1000.0), "discount": ("percent", 100.0), "tax": ("percent", 100.0)}
ERRORS = ("n", "mae", "rmse", "bias", "loa_lower", "loa_upper")


def native_unit_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in each feature's own unit, scaled before they are taken."""
    unit = F.create_map(*(F.lit(v) for f, (u, _) in UNITS.items() for v in (f, u)))[F.col("feature")]
    scale = F.create_map(*(F.lit(v) for f, (_, s) in UNITS.items() for v in (f, s)))[F.col("feature")]
    pairs = paired(obs(spark, sf_dir)).select("feature", unit.alias("unit"), (F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y"))
    return show(A.agreement(pairs, ["feature", "unit"]), ["feature", "unit"], ERRORS)


PROP = ("n", "bias", "prop_slope", "prop_intercept", "prop_r", "prop_se")


def bland_altman_prop_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the difference grow with the size measured? Per condition and feature."""
    return show(A.agreement(paired(obs(spark, sf_dir), "condition"), ["condition", "feature"]), ["condition", "feature"], PROP)


def proportional_bias_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope's two-sided p from Student's t."""
    m = A.slope_p_value(A.agreement(paired(obs(spark, sf_dir)), ["feature"]))
    return m.select("feature", "n", r6("prop_slope").alias("prop_slope"), r6("prop_p").alias("prop_p"))


REPS = 2000
CI = ("icc_a1", "icc_c1", "ccc", "pearson", "mae", "rmse", "bias", "prop_slope")


def cluster_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals over participants drawn with replacement; draws are arithmetic so that SQL can repeat them."""
    pairs = paired(obs(spark, sf_dir))
    sums = R.cluster_sums(pairs, ["feature"], "participant")
    draw = (F.col("rep") * 7919 + F.col("slot") * 104729 + F.col("rep") * F.col("slot") * 31).cast("long")
    weights = R.drawn_weights(pairs, "participant", REPS, draw)
    ci = R.percentile_ci(R.replicated(sums, weights, ["feature"], "participant"), ["feature"], CI)
    return ci.select("feature", *(r6(f"{m}_{e}").alias(f"{m}_{e}") for m in CI for e in ("low", "high")))


def union_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions one by one, and all together under a name of its own, in one table; columns that one lacks are null."""
    o = obs(spark, sf_dir)
    by = A.agreement(paired(o, "condition"), ["condition", "feature"]).select("condition", "feature", "n", "icc_a1", "bias")
    whole = A.agreement(paired(o), ["feature"]).select(F.lit("all").alias("condition"), "feature", "n", "icc_a1")
    return show(by.unionByName(whole, allowMissingColumns=True), ["condition", "feature"], ("n", "icc_a1", "bias"))


def before_after_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How condition N changes the metrics of condition A."""
    m = A.agreement(paired(obs(spark, sf_dir), "condition"), ["condition", "feature"])
    before, after = (m.filter(F.col("condition") == c).select("feature", F.col("icc_a1").alias(f"icc_{w}"), F.col("rmse").alias(f"rmse_{w}")) for c, w in (("A", "before"), ("N", "after")))
    j = before.join(after, "feature")
    change = F.col("rmse_after") - F.col("rmse_before")
    return j.select("feature", r6(F.col("icc_after") - F.col("icc_before")).alias("icc_change"), r6(change).alias("rmse_change"), r6(100 * change / F.nullif(F.col("rmse_before"), F.lit(0.0))).alias("rmse_change_percent"))


def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two metrics per condition side by side, columns named metric_condition."""
    m = A.agreement(paired(obs(spark, sf_dir), "condition"), ["condition", "feature"])
    wide = m.groupBy("feature").pivot("condition", list(CONDITIONS)).agg(F.first("icc_a1").alias("icc_a1"), F.first("rmse").alias("rmse"))
    return wide.select("feature", *(r6(f"{c}_{k}").alias(f"{k}_{c}") for k in ("icc_a1", "rmse") for c in CONDITIONS))


def loso_mean_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict a cell's y by the mean over all other participants: totals less the participant's own, no theta join."""
    p = paired(obs(spark, sf_dir))
    own = p.groupBy("feature", "participant").agg(F.sum("y").alias("s"), F.count("y").alias("k"))
    total = own.groupBy("feature").agg(F.sum("s").alias("ts"), F.sum("k").alias("tk"))
    base = own.join(total, "feature").select("feature", "participant", ((F.col("ts") - F.col("s")) / F.nullif(F.col("tk") - F.col("k"), F.lit(0))).alias("mean"))
    return p.join(base, ["feature", "participant"]).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs(F.col("y") - F.col("mean")))).alias("mae"), r6(F.sqrt(F.avg(F.pow(F.col("y") - F.col("mean"), 2)))).alias("rmse"))


_BOOT = f"""
SELECT feature, {", ".join(f"round(quantile_cont({m}, {q}), 6) + 0.0 AS {m}_{e}" for m in CI for e, q in (("low", 0.025), ("high", 0.975)))} FROM (SELECT * FROM boot) GROUP BY feature"""
SQL = {
    "agreement_primary": f"WITH {OBS}, {paired_sql()}, {metrics_sql('paired', 'feature')} SELECT feature, {show_sql()} FROM metrics",
    "agreement_by_condition": f"WITH {OBS}, {paired_sql(', condition')}, {metrics_sql('paired', 'condition, feature')} SELECT condition, feature, {show_sql()} FROM metrics",
    "agreement_gesture_wise": f"WITH {OBS}, {paired_sql()}, {metrics_sql('paired', 'gesture, feature')} SELECT gesture, feature, {show_sql()} FROM metrics",
    "agreement_static_subset": f"WITH {OBS}, still AS (SELECT * FROM obs WHERE gesture IN (1, 2, 3)), {paired_sql(source='still')}, {metrics_sql('paired', 'feature')} SELECT feature, {show_sql()} FROM metrics",
    "native_unit_errors": f"""WITH {OBS}, {paired_sql()}, scaled AS (SELECT feature, unit, x * k AS x, y * k AS y FROM paired JOIN (VALUES
 {", ".join(f"('{f}', '{u}', {s}::DOUBLE)" for f, (u, s) in UNITS.items())}) AS u(feature, unit, k) USING (feature)), {metrics_sql('scaled', 'feature, unit')} SELECT feature, unit, {show_sql(ERRORS)} FROM metrics""",
    "bland_altman_prop_bias": f"WITH {OBS}, {paired_sql(', condition')}, {metrics_sql('paired', 'condition, feature')} SELECT condition, feature, {show_sql(PROP)} FROM metrics",
    "cluster_bootstrap_ci": f"""WITH {OBS}, {paired_sql()}, who AS (SELECT participant, row_number() OVER (ORDER BY participant) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT participant FROM paired)),
 slots AS (SELECT rep, slot FROM range(0, {REPS}) AS r(rep), range(0, (SELECT count(*) FROM who)) AS s(slot)),
 picked AS (SELECT rep, participant FROM slots JOIN who ON i = (rep * 7919 + slot * 104729 + rep * slot * 31) % k),
 many AS (SELECT rep, feature, x, y FROM picked JOIN paired USING (participant)), {metrics_sql('many', 'feature, rep', name='boot')} {_BOOT}""",
    "union_conditions": f"""WITH {OBS}, {paired_sql(', condition')}, {paired_sql(name='pooled')}, {metrics_sql('paired', 'condition, feature')}, {metrics_sql('pooled', 'feature', name='whole')}
 SELECT condition, feature, n, round(icc_a1, 6) + 0.0 AS icc_a1, round(bias, 6) + 0.0 AS bias FROM metrics UNION ALL SELECT 'all', feature, n, round(icc_a1, 6) + 0.0, NULL FROM whole""",
    "before_after_delta": f"""WITH {OBS}, {paired_sql(', condition')}, {metrics_sql('paired', 'condition, feature')} SELECT a.feature, round(b.icc_a1 - a.icc_a1, 6) + 0.0 AS icc_change,
 round(b.rmse - a.rmse, 6) + 0.0 AS rmse_change, round(100 * (b.rmse - a.rmse) / nullif(a.rmse, 0), 6) + 0.0 AS rmse_change_percent FROM metrics a JOIN metrics b ON a.feature = b.feature AND a.condition = 'A' AND b.condition = 'N'""",
    "metric_pivot": f"""WITH {OBS}, {paired_sql(', condition')}, {metrics_sql('paired', 'condition, feature')} SELECT feature,
 {", ".join(f"round(max({k}) FILTER (condition = '{c}'), 6) + 0.0 AS {k}_{c}" for k in ('icc_a1', 'rmse') for c in CONDITIONS)} FROM metrics GROUP BY feature""",
    "loso_mean_baseline": f"""WITH {OBS}, {paired_sql()}, who AS (SELECT DISTINCT participant FROM paired),
 base AS (SELECT p.feature, w.participant, avg(p.y) AS mean FROM who w JOIN paired p ON p.participant <> w.participant GROUP BY ALL)
 SELECT feature, count(*)::BIGINT AS n, round(avg(abs(y - mean)), 6) + 0.0 AS mae, round(sqrt(avg(pow(y - mean, 2))), 6) + 0.0 AS rmse FROM paired JOIN base USING (feature, participant) GROUP BY feature""",
}
QUERIES = {f.__name__: f for f in (agreement_primary, agreement_by_condition, agreement_gesture_wise, agreement_static_subset, native_unit_errors, bland_altman_prop_bias, proportional_bias_p, cluster_bootstrap_ci, union_conditions, before_after_delta, metric_pivot, loso_mean_baseline)}
