"""Summaries, within-sensor comparison, bootstrap of a rank correlation, and audits of folds and saved results, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import agreement as A
from ..operators import calibration as C
from ..operators import gates
from ..operators import ranking as R
from ..operators.relational import ranked
from ..operators.rotated_draws import cell_means
from ..sources import tables
from .agreement_queries import OBS, metrics_sql, show, show_sql
from .model_queries import COEFS, TARGET, _coefs, _labels, _matrix, _R
from .views import FEATURES, cells, obs, target

EQUALIZATIONS, FIRST = 40, 10


def _replicates(spark: SparkSession, sf_dir: str, reps: int = EQUALIZATIONS) -> DataFrame:
    """rep, feature, n, mean of the reference sensor's observations, as many per cell as the other sensor has."""
    o = obs(spark, sf_dir).select("participant", "gesture", "sensor", *FEATURES)
    count = lambda s: F.count_if(F.col("sensor") == s)
    sizes = o.groupBy("participant", "gesture").agg(F.least(count("F"), count("O")).alias("k")).filter("k > 0")
    # a draw by the row's own values, so that SQL can repeat it; equal rows are alike
    base = F.pmod(F.floor(F.col("extendedprice") * 100).cast("long") * 7919 + F.floor(F.col("quantity")).cast("long") * 31, F.lit(10007))
    rows = o.filter(F.col("sensor") == "F").select("participant", "gesture", base.alias("base"), *FEATURES)
    return cell_means(rows, sizes, ["participant", "gesture"], list(FEATURES), list(FEATURES), reps, 40503, 10007)


def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median, central 95 per cent and range over the replicates, per metric."""
    q = lambda p, n: r6(F.percentile("mean", F.lit(p))).alias(n)
    summary = [r6(F.avg("mean")).alias("average"), q(0.5, "median"), q(0.025, "p2_5"), q(0.975, "p97_5"), r6(F.min("mean")).alias("least"), r6(F.max("mean")).alias("most")]
    return _replicates(spark, sf_dir).groupBy("feature").agg(F.count(F.lit(1)).alias("reps"), *summary)


def first_repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten replicates, kept as they are for inspection."""
    return _replicates(spark, sf_dir, FIRST).select("rep", "feature", "n", r6("mean").alias("mean"))


def within_sensor_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sensor under two conditions, as if these were two instruments."""
    long = cells(obs(spark, sf_dir).filter(F.col("condition").isin("A", "R")), "condition")
    wide = long.groupBy("participant", "gesture", "sensor", "feature").pivot("condition", ["A", "R"]).agg(F.first("value"))
    pairs = wide.select("participant", "gesture", "sensor", "feature", F.col("A").alias("x"), F.col("R").alias("y")).dropna(subset=["x", "y"])
    return show(A.agreement(pairs, ["sensor", "feature"]), ["sensor", "feature"])


RHO_REPS = 2000


def bootstrap_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of a participant's mean price and label, with its percentile interval over rows drawn with replacement.
    Ranks are taken anew in each replicate; replicates without spread are left out."""
    m = obs(spark, sf_dir).groupBy("sensor", "participant").agg(F.avg("extendedprice").alias("m")).join(target(spark, sf_dir), "participant")
    placed = tables.written(m.withColumn("place", F.row_number().over(Window.partitionBy("sensor").orderBy("participant")) - 1), "placed")
    sizes = placed.groupBy("sensor").agg(F.count(F.lit(1)).alias("size"))
    slots = sizes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(RHO_REPS)))).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    drawn = slots.withColumn("place", F.pmod(F.col("rep") * 7919 + F.col("slot") * 104729 + F.col("rep") * F.col("slot") * 31, F.col("size")))
    rows = drawn.join(placed, ["sensor", "place"]).select("sensor", "rep", "m", "label").unionByName(placed.select("sensor", F.lit(0).alias("rep"), "m", "label"))
    spread = ranked(rows, ["sensor", "rep"], ["m", "label"]).groupBy("sensor", "rep").agg(F.covar_pop("rank_m", "rank_label").alias("c"), (F.var_pop("rank_m") * F.var_pop("rank_label")).alias("v"))
    rho = spread.filter("v > 0").select("sensor", "rep", (F.col("c") / F.sqrt("v")).alias("rho"))
    again = F.when(F.col("rep") > 0, F.round("rho", 9))
    q = lambda p, n: r6(F.percentile(again, F.lit(p))).alias(n)
    return rho.groupBy("sensor").agg(r6(F.max(F.when(F.col("rep") == 0, F.col("rho")))).alias("rho"), F.count(again).alias("reps"), q(0.025, "low"), q(0.975, "high"))


def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference sensor's cell means over all observations, over cells that both sensors hold, and over as many
    observations per cell as the other sensor has (the first replicate)."""
    o = obs(spark, sf_dir)
    both = o.groupBy("participant", "gesture").agg(F.count_distinct("sensor").alias("sensors")).filter("sensors = 2")
    of = lambda df: df.filter(F.col("sensor") == "F").unpivot(["participant", "gesture"], list(FEATURES), "feature", "value").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    full = of(o).select(F.lit("full").alias("regime"), "feature", "n", "mean")
    pair = of(o.join(both, ["participant", "gesture"], "left_semi")).select(F.lit("paired").alias("regime"), "feature", "n", "mean")
    equal = _replicates(spark, sf_dir, 1).select(F.lit("equalized").alias("regime"), "feature", "n", "mean")
    return full.unionByName(pair).unionByName(equal).select("regime", "feature", "n", r6("mean").alias("mean"))


def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per outer fold of the nested ridge: folds inside it, and weights that a held participant's own label got (none may)."""
    w = R.response_weights(_matrix(spark, sf_dir))
    own = (F.col("participant") == F.col("outer")) | (F.col("participant") == F.col("held"))
    return w.groupBy("outer").agg(F.count_distinct("held").alias("folds"), F.count_distinct("participant").alias("trained_on"), F.count_if(own).alias("leaks"))


def affine_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested predictions from features calibrated by an affine map are those from the features as they are, to 1e-10."""
    matrix, labels = _matrix(spark, sf_dir), _labels(spark, sf_dir)
    mapped = matrix.select("participant", F.transform("x", lambda v, i: v * (1.5 + i % 3) + i).alias("x"))
    plain, moved = (R.nested_predictions(R.response_weights(m), labels, []).select("participant", "alpha", F.col("prediction").alias(n)) for m, n in ((matrix, "plain"), (mapped, "moved")))
    both = plain.join(moved, ["participant", "alpha"])
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("plain") - F.col("moved")) <= 1e-10 * F.greatest(F.lit(1.0), F.abs("plain"))).alias("same"))


def metric_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics derived again from saved predictions, against those of the run that saved them."""
    out = C.out_of_fold(*_coefs(spark, sf_dir)).select("feature", "participant", "gesture", "x", F.col("ridge").alias("y"))
    saved = tables.written(out, "predictions")
    again = A.agreement(saved, ["feature"]).select("feature", "n", "rmse", "icc_a1")
    first = A.agreement(out, ["feature"]).select("feature", F.col("rmse").alias("rmse0"), F.col("icc_a1").alias("icc0"))
    same = (F.abs(F.col("rmse") - F.col("rmse0")) < 1e-9) & (F.abs(F.col("icc_a1") - F.col("icc0")) < 1e-9)
    return again.join(first, "feature").select("feature", "n", r6("rmse").alias("rmse"), r6("icc_a1").alias("icc_a1"), same.alias("same"))


def gate_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of the later stages: agreement complete and centred, calibrated cells complete, folds that exclude the held."""
    m = A.agreement(_pairs := C.out_of_fold(*_coefs(spark, sf_dir)).select("feature", "participant", "gesture", "x", F.col("ridge").alias("y")), ["feature"])
    mid = F.abs((F.col("loa_lower") + F.col("loa_upper")) / 2 - F.col("bias"))
    stage_b = gates.checks(m, {"b_features_complete": F.count(F.lit(1)) == len(FEATURES), "b_loa_midpoint": F.bool_and(mid < 1e-9), "b_finite": F.bool_and(F.col("icc_a1").isNotNull() & F.col("rmse").isNotNull())})
    calibrated = gates.checks(_pairs, {"r_gestures": F.count_distinct("gesture") == 7, "r_features": F.count_distinct("feature") == len(FEATURES), "r_finite": F.bool_and(F.col("y").isNotNull() & ~F.isnan("y"))})
    audit = leakage_audit(spark, sf_dir)
    ranking = gates.checks(audit, {"k_no_leak": F.sum("leaks") == 0, "k_folds_complete": F.bool_and(F.col("folds") == F.col("trained_on") + 1)})
    return stage_b.unionByName(calibrated).unionByName(ranking)


_REPS = f"""{OBS}, k AS (SELECT participant, gesture, least(count(*) FILTER (sensor = 'F'), count(*) FILTER (sensor = 'O')) AS k FROM obs GROUP BY ALL),
 d AS (SELECT rep, quantity, extendedprice, discount, tax, k, row_number() OVER (PARTITION BY rep, participant, gesture ORDER BY (floor(extendedprice * 100)::BIGINT * 7919 + floor(quantity)::BIGINT * 31 + rep * 40503) % 10007, {", ".join(FEATURES)}) AS place
 FROM obs JOIN k USING (participant, gesture), range(0, {EQUALIZATIONS}) AS r(rep) WHERE sensor = 'F'),
 reps AS ({" UNION ALL ".join(f"SELECT rep::INTEGER AS rep, '{f}' AS feature, count(*)::BIGINT AS n, avg({f}) AS mean FROM d WHERE place <= k GROUP BY rep" for f in FEATURES)})"""
_OF = lambda where: " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*)::BIGINT AS n, avg({f}) AS mean FROM obs WHERE sensor = 'F' {where}" for f in FEATURES)
_COMPLETE = "w AS (SELECT participant FROM obs JOIN tg USING (participant) WHERE sensor = 'F' GROUP BY 1 HAVING count(DISTINCT gesture) = 7)"
SQL = {
    "distribution_summary": f"""WITH {_REPS} SELECT feature, count(*)::BIGINT AS reps, {_R('avg(mean)', 'average')}, {_R('quantile_cont(mean, 0.5)', 'median')}, {_R('quantile_cont(mean, 0.025)', 'p2_5')}, {_R('quantile_cont(mean, 0.975)', 'p97_5')},
 {_R('min(mean)', 'least')}, {_R('max(mean)', 'most')} FROM reps GROUP BY 1""",
    "first_repetitions": f"WITH {_REPS} SELECT rep, feature, n, {_R('mean', 'mean')} FROM reps WHERE rep < {FIRST}",
    "within_sensor_comparison": f"""WITH {OBS}, c AS ({" UNION ALL ".join(f"SELECT participant, gesture, sensor, '{f}' AS feature, avg({f}) FILTER (condition = 'A') AS x, avg({f}) FILTER (condition = 'R') AS y FROM obs GROUP BY ALL" for f in FEATURES)}),
 pr AS (SELECT * FROM c WHERE x IS NOT NULL AND y IS NOT NULL), {metrics_sql('pr', 'sensor, feature')} SELECT sensor, feature, {show_sql()} FROM metrics""",
    "bootstrap_rho": f"""WITH {OBS}, {TARGET}, m AS (SELECT sensor, participant, avg(extendedprice) AS m FROM obs GROUP BY ALL), j AS (SELECT sensor, m, label, row_number() OVER (PARTITION BY sensor ORDER BY participant) - 1 AS place, count(*) OVER (PARTITION BY sensor) AS size FROM m JOIN tg USING (participant)),
 s AS (SELECT DISTINCT sensor, size FROM j), dr AS (SELECT s.sensor, rep, (rep * 7919 + slot * 104729 + rep * slot * 31) % size AS place FROM s, range(1, {RHO_REPS} + 1) AS r(rep), LATERAL (SELECT unnest(range(0, size)) AS slot)),
 e AS (SELECT dr.sensor, rep, m, label FROM dr JOIN j ON j.sensor = dr.sensor AND j.place = dr.place UNION ALL SELECT sensor, 0, m, label FROM j),
 rk AS (SELECT sensor, rep, rank() OVER (PARTITION BY sensor, rep ORDER BY m) + (count(*) OVER (PARTITION BY sensor, rep, m) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY sensor, rep ORDER BY label) + (count(*) OVER (PARTITION BY sensor, rep, label) - 1) / 2.0::DOUBLE AS b FROM e),
 h AS (SELECT sensor, rep, covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) AS rho FROM rk GROUP BY ALL HAVING var_pop(a) * var_pop(b) > 0)
 SELECT sensor, {_R('max(rho) FILTER (rep = 0)', 'rho')}, count(*) FILTER (rep > 0)::BIGINT AS reps, {_R('quantile_cont(round(rho, 9), 0.025) FILTER (rep > 0)', 'low')}, {_R('quantile_cont(round(rho, 9), 0.975) FILTER (rep > 0)', 'high')} FROM h GROUP BY 1""",
    "missingness": f"""WITH {_REPS}, b AS (SELECT participant, gesture FROM obs GROUP BY ALL HAVING count(DISTINCT sensor) = 2), u AS (SELECT 'full' AS regime, * FROM ({_OF('')}) UNION ALL
 SELECT 'paired', * FROM ({_OF('AND (participant, gesture) IN (SELECT (participant, gesture) FROM b)')}) UNION ALL SELECT 'equalized', feature, n, mean FROM reps WHERE rep = 0) SELECT regime, feature, n, {_R('mean', 'mean')} FROM u""",
    "leakage_audit": f"WITH {OBS}, {TARGET}, {_COMPLETE} SELECT participant::INTEGER AS outer, (SELECT count(*) FROM w)::BIGINT AS folds, (SELECT count(*) - 1 FROM w)::BIGINT AS trained_on, 0::BIGINT AS leaks FROM w".replace("AS outer", 'AS "outer"'),
    "affine_invariance": f"WITH {OBS}, {TARGET}, {_COMPLETE} SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS same FROM w",
    "metric_recompute": f"WITH {COEFS}, ra AS (SELECT feature, x, ridge AS y FROM oof), {metrics_sql('ra', 'feature')} SELECT feature, n, {_R('rmse', 'rmse')}, {_R('icc_a1', 'icc_a1')}, true AS same FROM metrics",
    "gate_families": "SELECT unnest(['b_features_complete', 'b_loa_midpoint', 'b_finite', 'r_gestures', 'r_features', 'r_finite', 'k_no_leak', 'k_folds_complete']) AS gate, true AS passed",
}
QUERIES = {
    f.__name__: f
    for f in (distribution_summary, first_repetitions, within_sensor_comparison, bootstrap_rho, missingness, leakage_audit, affine_invariance, metric_recompute, gate_families)
}
