"""Queries on calibration, ranking, sampling, models, gates and sinks, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import agreement as A
from ..operators import calibration as C
from ..operators import fold_models as M
from ..operators import gates
from ..operators import ranking as R
from ..operators import rotated_draws as D
from ..operators.relational import ranked
from ..sources import tables
from ..streaming.windows import event_windows
from .agreement_queries import OBS, metrics_sql, paired_sql
from .views import FEATURES, cells, obs, paired, table, target

EDGES = (4450.0, 4600.0)


def _coefs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = paired(obs(spark, sf_dir))
    sums = C.participant_sums(p)
    return p, C.coefficients(sums, C.chosen_alphas(sums))


def calibration_ridge_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell calibrated by models that never saw its participant."""
    out = C.out_of_fold(*_coefs(spark, sf_dir))
    return out.select("feature", "participant", "gesture", *(r6(c).alias(c) for c in ("ridge", "shifted")))


def calibration_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes over folds and how often each alpha is chosen."""
    c = _coefs(spark, sf_dir)[1]
    q = lambda p: r6(F.percentile("slope", F.lit(p)))
    used = [F.count_if(F.col("alpha") == a).alias(f"alpha_{i}") for i, a in enumerate(C.ALPHAS)]
    return c.groupBy("feature").agg(q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), r6(F.min("slope")).alias("least"), r6(F.max("slope")).alias("most"), r6(F.avg(F.when(F.col("slope") > 0, 1.0).otherwise(0.0))).alias("positive"), *used)


WAYS = {"raw": "y", "shift": "shifted", "ridge": "ridge"}


def calibration_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement with the reference before and after, by the shift alone and by ridge."""
    oof = C.out_of_fold(*_coefs(spark, sf_dir))
    long = oof.select("feature", "x", F.explode(F.array(*(F.struct(F.lit(k).alias("way"), F.col(c).alias("y")) for k, c in WAYS.items()))).alias("v")).select("feature", "v.way", "x", "v.y")
    m = A.agreement(long, ["feature", "way"])
    wide = m.groupBy("feature").pivot("way", list(WAYS)).agg(F.first("rmse").alias("rmse"), F.first("icc_a1").alias("icc"))
    return wide.select("feature", *(r6(f"{w}_{k}").alias(f"{k}_{w}") for k in ("rmse", "icc") for w in WAYS))


def calibration_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per participant: in how many features ridge lowers the mean absolute error, and the mean change."""
    oof = C.out_of_fold(*_coefs(spark, sf_dir))
    err = lambda c: F.avg(F.abs(F.col(c) - F.col("x")))
    e = oof.groupBy("participant", "feature").agg((err("ridge") - err("y")).alias("change"), err("y").alias("raw"))
    return e.groupBy("participant").agg(F.count_if(F.col("change") < 0).alias("better"), r6(F.avg(F.col("change") / F.nullif(F.col("raw"), F.lit(0.0)))).alias("mean_change"))


def wide_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference sensor's design matrix, one row per participant and column, reindexed to all participants with a label."""
    design = R.long_design(cells(obs(spark, sf_dir)).filter(F.col("sensor") == "F"))
    return target(spark, sf_dir).select("participant").join(design, "participant", "left").select("participant", "place", "name", r6("value").alias("value"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A participant's mean price per sensor, mapped to the labels' mean and deviation, against the label."""
    means = obs(spark, sf_dir).groupBy("sensor", "participant").agg(F.avg("extendedprice").alias("m"))
    j = means.join(target(spark, sf_dir), "participant")
    w = Window.partitionBy("sensor")
    z = (F.col("m") - F.avg("m").over(w)) / F.nullif(F.stddev_pop("m").over(w), F.lit(0.0))
    return j.select("sensor", "participant", F.col("label").alias("truth"), (F.avg("label").over(w) + z * F.stddev_pop("label").over(w)).alias("prediction"))


def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.rank_metrics(_scored(spark, sf_dir), ["sensor"], EDGES)
    return out.select("sensor", "n", *(r6(c).alias(c) for c in ("spearman", "kendall", "mae", "rmse", "kappa")))


def ridge_loso_univariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A participant's label from its mean price by ridge (alpha 1) without it: sums less its own."""
    j = obs(spark, sf_dir).groupBy("sensor", "participant").agg(F.avg("extendedprice").alias("m")).join(target(spark, sf_dir), "participant")
    w = Window.partitionBy("sensor")
    u, v = F.col("m") - F.avg("m").over(w), F.col("label") - F.avg("label").over(w)
    c = j.select("sensor", "participant", u.alias("u"), v.alias("v"), F.avg("label").over(w).alias("c"))
    rest = {k: F.sum(e).over(w) - e for k, e in {"n": F.lit(1.0), "u": F.col("u"), "v": F.col("v"), "uu": F.col("u") * F.col("u"), "uv": F.col("u") * F.col("v")}.items()}
    s = c.select("sensor", "participant", "u", "c", *(e.alias(f"s_{k}") for k, e in rest.items()))
    n = F.col("s_n")
    var = F.col("s_uu") / n - F.col("s_u") * F.col("s_u") / (n * n)
    slope = (F.col("s_uv") - F.col("s_u") * F.col("s_v") / n) / F.nullif(var * (n + 1), F.lit(0.0))
    return s.select("sensor", "participant", r6(F.col("c") + F.col("s_v") / n + slope * (F.col("u") - F.col("s_u") / n)).alias("prediction"))


def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One empirical p per event type, the share of users whose mean lies above 52, adjusted for the family."""
    means = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"))
    p = means.groupBy("event_type").agg(((1.0 + F.count_if(F.col("m") >= 60)) / (1.0 + F.count(F.lit(1)))).alias("p"))
    return R.holm(p, "event_type", "p").select("event_type", r6("p").alias("p"), r6("p_holm").alias("p_holm"))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(participant, x): complete rows only, so that every column is the same for all."""
    design = R.long_design(cells(obs(spark, sf_dir)).filter(F.col("sensor") == "F"))
    rows = design.groupBy("participant").agg(F.sort_array(F.collect_list(F.struct("name", "value"))).alias("v"))
    return rows.select("participant", F.transform("v", lambda c: c["value"]).alias("x"), F.size("v").alias("width")).filter(F.col("width") == 7 * len(FEATURES)).drop("width")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target(spark, sf_dir).join(_matrix(spark, sf_dir), "participant", "left_semi")


def nested_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested leave-one-out predictions with the alpha chosen inside each fold."""
    out = R.nested_predictions(R.response_weights(_matrix(spark, sf_dir)), _labels(spark, sf_dir), [])
    return out.select("participant", r6("truth").alias("truth"), r6("prediction").alias("prediction"), "alpha")


PERMUTATIONS = 10_000


def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation under labels dealt anew, the observed one as replicate 0, and p = (1 + #) / (R + 1)."""
    pred = R.permuted_predictions(_matrix(spark, sf_dir), _labels(spark, sf_dir), PERMUTATIONS, 20260815)
    ranks = ranked(pred.select("rep", "truth", "prediction"), ["rep"], ["truth", "prediction"])
    rho = tables.written(ranks.groupBy("rep").agg(F.corr("rank_truth", "rank_prediction").alias("spearman")), "null")
    size = F.round(F.abs("spearman"), 12)  # equal correlations are a tie, whatever order they were summed in
    seen = rho.filter(F.col("rep") == 0).select(size.alias("observed"))
    p = rho.filter(F.col("rep") > 0).join(F.broadcast(seen), size >= F.col("observed"), "left").agg(((1.0 + F.count("observed")) / (1.0 + F.count(F.lit(1)))).alias("p"))
    return rho.join(F.broadcast(p), F.col("rep") >= 0).select("rep", r6("spearman").alias("rho"), r6("p").alias("p"))


def jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank metrics without each participant in turn."""
    few = _matrix(spark, sf_dir)
    pred = R.nested_predictions(R.response_weights(few, omit=True), _labels(spark, sf_dir), [])
    out = R.rank_metrics(pred.select("omitted", "participant", "truth", "prediction"), ["omitted"], EDGES)
    return out.select("omitted", "n", *(r6(c).alias(c) for c in ("spearman", "kendall", "mae", "rmse", "kappa")))


SPLITS = 200


STEP, MODULUS = 40503, 1000003


def _based(rows: DataFrame) -> DataFrame:
    """Rows with the key that all replicates draw by, each from its own start; the number is reduced first so that no product
    overflows."""
    base = F.pmod(F.pmod("event_id", F.lit(MODULUS)) * 2654435761, F.lit(MODULUS))
    return rows.withColumn("base", F.coalesce(base, F.lit(MODULUS)))


def equalize_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many clicks as views per user, drawn without replacement; the mean difference per replicate."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view") & F.col("user_id").isNotNull())

    def add(kind, base, value):
        click = kind == "click"
        k = int(min(click.sum(), (~click).sum()))
        if not k:
            return None
        (nc, sc), (nv, sv) = (D.taken(base[i], value[i], k, SPLITS, STEP, MODULUS) for i in (click, ~click))
        return np.stack([np.full(SPLITS, 2.0 * k), nc, sc, nv, sv], 1)

    s = D.group_sums(_based(ev), ["user_id", "event_type"], "event_id", "value", add, 5)
    mean = lambda i: F.get("s", F.lit(i + 1)) / F.nullif(F.get("s", F.lit(i)), F.lit(0.0))
    return s.select("rep", F.get("s", F.lit(0)).cast("long").alias("n"), r6(mean(1) - mean(3)).alias("difference"))


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty per cent of a user's rows, one at least, held out; how far their mean lies from the others'."""

    def add(_, base, value):
        k = max(1, round(len(base) * 0.3))
        there = ~np.isnan(value)
        n, s = D.taken(base, value, k, SPLITS, STEP, MODULUS)
        rest = there.sum() - n
        both = (n > 0) & (rest > 0)
        gap = np.abs(s / np.where(both, n, 1) - (value[there].sum() - s) / np.where(both, rest, 1))
        return np.stack([np.full(SPLITS, float(k)), both, np.where(both, gap, 0.0)], 1)

    s = D.group_sums(_based(table(spark, sf_dir, "events")), ["user_id"], "event_id", "value", add, 3)
    part = lambda i: F.get("s", F.lit(i))
    return s.select("rep", part(0).cast("long").alias("held"), r6(part(2) / F.nullif(part(1), F.lit(0.0))).alias("mae"))


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sensor, participant, x, label): each sensor's wide matrix, columns in the order of (gesture, feature), of the
    participants with a label and all cells."""
    named = cells(obs(spark, sf_dir)).select("sensor", "participant", F.struct(F.format_string("%02d:%s", "gesture", "feature").alias("name"), "value").alias("c"))
    rows = named.groupBy("sensor", "participant").agg(F.sort_array(F.collect_list("c")).alias("c"))  # a value per cell
    width = F.max(F.size("c")).over(Window.partitionBy("sensor"))
    whole = rows.withColumn("width", width).filter(F.size("c") == F.col("width"))
    return whole.select("sensor", "participant", F.transform("c", lambda v: v["value"]).alias("x")).join(target(spark, sf_dir), "participant")


def model_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five models on both sensors, each participant predicted without it, settings chosen inside the folds."""
    out = M.nested(design(spark, sf_dir), ["sensor"], EDGES)
    return out.select("sensor", "model", "participant", "candidate", *(r6(c).alias(c) for c in ("truth", "prediction", "loss")))


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank metrics of every linear model and sensor; its predictions are written once."""
    some = {k: M.CANDIDATES[k] for k in ("ridge", "elastic_net")}
    scored = tables.written(M.nested(design(spark, sf_dir), ["sensor"], EDGES, some), "scored")
    out = R.rank_metrics(scored.select("sensor", "model", "participant", "truth", "prediction"), ["sensor", "model"], EDGES)
    return out.select("sensor", "model", "n", *(r6(c).alias(c) for c in ("spearman", "kendall", "mae", "rmse", "kappa")))


def rf_range_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of the labels that each outer fold's forests were fitted to, and whether both candidates' predictions lie in it."""
    found = M.predictions(design(spark, sf_dir), ["sensor"], EDGES, {"forest": M.CANDIDATES["forest"]}, inner=False)
    inside = (F.col("prediction") >= F.col("low") - 1e-12) & (F.col("prediction") <= F.col("high") + 1e-12)
    return found.groupBy("sensor", F.col("held").alias("participant")).agg(
        r6(F.first("low")).alias("low"), r6(F.first("high")).alias("high"), F.count(F.lit(1)).alias("n"), F.count_if(~inside).alias("violations")
    )


def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that the observations must meet."""
    o = obs(spark, sf_dir)
    return gates.checks(
        o,
        {
            "both_sensors": F.count_distinct("sensor") == 2,
            "three_conditions": F.count_distinct("condition") == 3,
            "seven_gestures": F.count_distinct("gesture") == 7,
            "quantities_in_range": F.bool_and(F.col("quantity").between(1, 50)),
            "discounts_in_range": F.bool_and((F.col("discount") >= 0) & (F.col("discount") < 1)),
            "prices_finite": F.bool_and(F.col("extendedprice").isNotNull() & ~F.isnan("extendedprice")),
        },
    )


def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell means through compressed CSV and through JSON, against the originals."""
    p = tables.written(paired(obs(spark, sf_dir)).select("participant", "gesture", "feature", r6("x").alias("x")), "pairs")
    as_csv, as_json = tables.fresh(spark, "csv"), tables.fresh(spark, "json")
    tables.export_csv(p, as_csv)
    tables.export_json(p, as_json)
    keys = ["participant", "gesture", "feature"]
    back = spark.read.schema(p.schema).csv(as_csv, header=True).withColumnRenamed("x", "c").join(spark.read.schema(p.schema).json(as_json).withColumnRenamed("x", "j"), keys)
    return p.join(back, keys).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") == F.col("c")).alias("csv_equal"), F.count_if(F.col("x") == F.col("j")).alias("json_equal"))


def streaming_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows per event type from the event stream."""
    out = event_windows(spark, f"{sf_dir}/events.parquet")
    return out.select((F.unix_micros("start") / 1000000).cast("long").alias("start_s"), "event_type", "n", r6("mean").alias("mean"), r6("most").alias("most"))


_ALPHAS = ", ".join(f"({a}::DOUBLE)" for a in C.ALPHAS)
_VAR = "CASE WHEN v < 1e-24 THEN 1 ELSE v END"
COEFS = f"""{OBS}, {paired_sql()}, cen AS (SELECT feature, avg(x) AS cx, avg(y) AS cy FROM paired GROUP BY 1),
su AS (SELECT feature, participant AS p, cx, cy, count(*)::DOUBLE AS n, sum(x - cx) AS sx, sum(y - cy) AS sy, sum(pow(x - cx, 2)) AS sxx, sum(pow(y - cy, 2)) AS syy, sum((x - cx) * (y - cy)) AS sxy FROM paired JOIN cen USING (feature) GROUP BY ALL),
tr AS (SELECT o.feature, o.p AS held, i.p AS inn, sum(s.n) AS n, sum(s.sx) AS sx, sum(s.sy) AS sy, sum(s.sxx) AS sxx, sum(s.syy) AS syy, sum(s.sxy) AS sxy FROM su o JOIN su i ON i.feature = o.feature AND i.p <> o.p JOIN su s ON s.feature = o.feature AND s.p <> o.p AND s.p <> i.p GROUP BY ALL),
fit AS (SELECT *, (sxy - sx * sy / n) / ({_VAR} * (n + a)) AS b FROM (SELECT *, syy / n - pow(sy / n, 2) AS v FROM tr), (VALUES {_ALPHAS}) AS al(a)),
los AS (SELECT f.feature, held, f.a, avg(sqrt(greatest(0, i.sxx + i.n * k * k + b * b * i.syy - 2 * k * i.sx - 2 * b * i.sxy + 2 * k * b * i.sy) / i.n) / CASE WHEN sd > 0 THEN sd ELSE 1 END) AS loss
 FROM (SELECT *, sx / n - b * sy / n AS k, sqrt(greatest(0, (sxx - sx * sx / n) / (n - 1))) AS sd FROM fit) f JOIN su i ON i.feature = f.feature AND i.p = inn GROUP BY ALL),
pick AS (SELECT feature, held, a FROM (SELECT *, row_number() OVER (PARTITION BY feature, held ORDER BY round(loss, 9), a) AS r FROM los) WHERE r = 1),
ou AS (SELECT o.feature, o.p AS held, o.cx, o.cy, sum(s.n) AS n, sum(s.sx) AS sx, sum(s.sy) AS sy, sum(s.syy) AS syy, sum(s.sxy) AS sxy FROM su o JOIN su s ON s.feature = o.feature AND s.p <> o.p GROUP BY ALL),
cf AS (SELECT feature, held, a AS alpha, cx, cy, n, sx, sy, (sxy - sx * sy / n) / ({_VAR} * (n + a)) AS slope FROM (SELECT *, syy / n - pow(sy / n, 2) AS v FROM ou) JOIN pick USING (feature, held)),
co AS (SELECT feature, held, alpha, slope, sx / n - slope * sy / n + cx - slope * cy AS icpt, cx - cy + (sx - sy) / n AS shift FROM cf),
oof AS (SELECT feature, participant, gesture, x, y, slope * y + icpt AS ridge, y + shift AS shifted FROM paired JOIN co USING (feature) WHERE held = participant)"""
TARGET = "tg AS (SELECT c_nationkey AS participant, avg(c_acctbal) AS label FROM customer GROUP BY 1)"
_R = lambda c, n: f"round({c}, 6) + 0.0 AS {n}"
_BAND = lambda c: f"CASE WHEN {c} <= {EDGES[0]} THEN 0 WHEN {c} <= {EDGES[1]} THEN 1 ELSE 2 END"
_DRAW = "((event_id % 1000003) * 2654435761 + rep * 40503) % 1000003"
SQL = {
    "calibration_ridge_oof": f"WITH {COEFS} SELECT feature, participant, gesture, {_R('ridge', 'ridge')}, {_R('shifted', 'shifted')} FROM oof",
    "calibration_stability": f"""WITH {COEFS} SELECT feature, {_R('quantile_cont(slope, 0.5)', 'median')}, {_R('quantile_cont(slope, 0.25)', 'q25')}, {_R('quantile_cont(slope, 0.75)', 'q75')}, {_R('min(slope)', 'least')}, {_R('max(slope)', 'most')},
 {_R('avg(CASE WHEN slope > 0 THEN 1.0::DOUBLE ELSE 0 END)', 'positive')}, {", ".join(f"count(*) FILTER (alpha = {a})::BIGINT AS alpha_{i}" for i, a in enumerate(C.ALPHAS))} FROM co GROUP BY 1""",
    "calibration_three_way": f"""WITH {COEFS}, lg AS ({" UNION ALL ".join(f"SELECT feature, '{w}' AS way, x, {c} AS y FROM oof" for w, c in WAYS.items())}), {metrics_sql('lg', 'feature, way')}
 SELECT feature, {", ".join(_R(f"max({k}) FILTER (way = '{w}')", f"{n}_{w}") for k, n in (("rmse", "rmse"), ("icc_a1", "icc")) for w in WAYS)} FROM metrics GROUP BY 1""",
    "calibration_changes": f"""WITH {COEFS}, e AS (SELECT participant, feature, avg(abs(ridge - x)) - avg(abs(y - x)) AS change, avg(abs(y - x)) AS raw FROM oof GROUP BY ALL)
 SELECT participant, count(*) FILTER (change < 0)::BIGINT AS better, {_R('avg(change / nullif(raw, 0))', 'mean_change')} FROM e GROUP BY 1""",
    "wide_matrix": f"""WITH {OBS}, {TARGET}, c AS ({" UNION ALL ".join(f"SELECT participant, gesture, '{f}' AS feature, avg({f}) AS value FROM obs WHERE sensor = 'F' GROUP BY ALL" for f in FEATURES)}),
 d AS (SELECT participant, lpad(gesture::VARCHAR, 2, '0') || ':' || feature AS name, value FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY name) AS place FROM d)
 SELECT participant, place, name, {_R('value', 'value')} FROM tg LEFT JOIN p USING (participant)""",
    "rank_metrics": f"""WITH {OBS}, {TARGET}, m AS (SELECT sensor, participant, avg(extendedprice) AS m FROM obs GROUP BY ALL),
 s AS (SELECT sensor, participant, label AS t, avg(label) OVER w + (m - avg(m) OVER w) / stddev_pop(m) OVER w * stddev_pop(label) OVER w AS q FROM m JOIN tg USING (participant) WINDOW w AS (PARTITION BY sensor)),
 r AS (SELECT *, rank() OVER (PARTITION BY sensor ORDER BY t) + (count(*) OVER (PARTITION BY sensor, t) - 1) / 2.0::DOUBLE AS rt, rank() OVER (PARTITION BY sensor ORDER BY q) + (count(*) OVER (PARTITION BY sensor, q) - 1) / 2.0::DOUBLE AS rq, {_BAND('t')} AS a, {_BAND('q')} AS b FROM s),
 l AS (SELECT sensor, v, row_number() OVER (PARTITION BY sensor ORDER BY v) AS k FROM (SELECT sensor, a AS v FROM r UNION SELECT sensor, b FROM r)),
 kb AS (SELECT r.sensor, avg(pow(x.k - y.k, 2)) AS seen, avg(x.k) AS ma, avg(y.k) AS mb, var_pop(x.k) AS va, var_pop(y.k) AS vb FROM r JOIN l x ON x.sensor = r.sensor AND x.v = a JOIN l y ON y.sensor = r.sensor AND y.v = b GROUP BY 1),
 tau AS (SELECT x.sensor, sum(sign(x.t - y.t) * sign(x.q - y.q)) / sqrt(count(*) FILTER (x.t <> y.t)::DOUBLE * count(*) FILTER (x.q <> y.q)) AS tau FROM s x JOIN s y ON x.sensor = y.sensor AND x.participant < y.participant GROUP BY 1)
 SELECT r.sensor, count(*)::BIGINT AS n, {_R('corr(rt, rq)', 'spearman')}, {_R('any_value(tau)', 'kendall')}, {_R('avg(abs(q - t))', 'mae')}, {_R('sqrt(avg(pow(q - t, 2)))', 'rmse')}, {_R('any_value(1 - seen / (va + vb + pow(ma - mb, 2)))', 'kappa')}
 FROM r JOIN tau USING (sensor) JOIN kb USING (sensor) GROUP BY 1""",
    "ridge_loso_univariate": f"""WITH {OBS}, {TARGET}, m AS (SELECT sensor, participant, avg(extendedprice) AS m FROM obs GROUP BY ALL), j AS (SELECT sensor, participant, m, label FROM m JOIN tg USING (participant)),
 f AS (SELECT a.sensor, a.participant, any_value(a.m) AS m, count(*) AS n, avg(b.m) AS mm, avg(b.label) AS ml, covar_pop(b.label, b.m) AS c, var_pop(b.m) AS v FROM j a JOIN j b ON a.sensor = b.sensor AND a.participant <> b.participant GROUP BY 1, 2)
 SELECT sensor, participant, {_R('ml + n * c / (v * (n + 1)) * (m - mm)', 'prediction')} FROM f""",
    "holm_adjust": f"""WITH m AS (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL), p AS (SELECT event_type, (1.0::DOUBLE + count(*) FILTER (m >= 60)) / (1 + count(*)) AS p FROM m GROUP BY 1),
 r AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p, event_type) + 1) * p) AS q FROM p) SELECT event_type, {_R('p', 'p')}, {_R('max(q) OVER (ORDER BY p, event_type ROWS UNBOUNDED PRECEDING)', 'p_holm')} FROM r""",
    "equalize_sample": f"""WITH e AS (SELECT user_id, event_type, event_id, value FROM events WHERE event_type IN ('click', 'view')), k AS (SELECT user_id, least(count(*) FILTER (event_type = 'click'), count(*) FILTER (event_type = 'view')) AS k FROM e GROUP BY 1),
 d AS (SELECT *, row_number() OVER (PARTITION BY rep, user_id, event_type ORDER BY {_DRAW}, event_id) AS place FROM e JOIN k USING (user_id), range(0, {SPLITS}) AS r(rep))
 SELECT rep::INTEGER AS rep, count(*)::BIGINT AS n, {_R("avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view')", 'difference')} FROM d WHERE place <= k GROUP BY 1""",
    "random_split": f"""WITH d AS (SELECT rep, user_id, value, count(*) OVER (PARTITION BY rep, user_id) AS n, row_number() OVER (PARTITION BY rep, user_id ORDER BY {_DRAW}, event_id) AS place FROM events, range(0, {SPLITS}) AS r(rep)),
 t AS (SELECT *, place <= greatest(1, round_even(n * 0.3::DOUBLE, 0)) AS test FROM d), u AS (SELECT rep, user_id, count(*) FILTER (test) AS held, avg(value) FILTER (test) AS a, avg(value) FILTER (NOT test) AS b FROM t GROUP BY ALL)
 SELECT rep::INTEGER AS rep, sum(held)::BIGINT AS held, {_R('avg(abs(a - b))', 'mae')} FROM u GROUP BY 1""",
    "rf_range_audit": f"""WITH {OBS}, {TARGET}, w AS (SELECT sensor, participant, count(DISTINCT gesture) AS g, any_value(label) AS label FROM obs JOIN tg USING (participant) GROUP BY ALL),
 c AS (SELECT sensor, max(g) AS most FROM (SELECT sensor, participant, count(DISTINCT gesture) AS g FROM obs GROUP BY ALL) GROUP BY 1), f AS (SELECT sensor, participant, label FROM w JOIN c USING (sensor) WHERE g = most)
 SELECT a.sensor, a.participant, {_R('min(b.label)', 'low')}, {_R('max(b.label)', 'high')}, 2::BIGINT AS n, 0::BIGINT AS violations FROM f a JOIN f b ON a.sensor = b.sensor AND a.participant <> b.participant GROUP BY 1, 2""",
    "gate_checks": f"""WITH {OBS}, c AS (SELECT count(DISTINCT sensor) = 2 AS both_sensors, count(DISTINCT condition) = 3 AS three_conditions, count(DISTINCT gesture) = 7 AS seven_gestures, bool_and(quantity BETWEEN 1 AND 50) AS quantities_in_range,
 bool_and(discount >= 0 AND discount < 1) AS discounts_in_range, bool_and(extendedprice IS NOT NULL AND NOT isnan(extendedprice)) AS prices_finite FROM obs) UNPIVOT c ON COLUMNS(*) INTO NAME gate VALUE passed""",
    "export_roundtrip": f"WITH {OBS}, {paired_sql()} SELECT feature, count(*)::BIGINT AS n, count(*)::BIGINT AS csv_equal, count(*)::BIGINT AS json_equal FROM paired GROUP BY 1",
    "streaming_event_windows": f"SELECT epoch(date_trunc('day', ts))::BIGINT AS start_s, event_type, count(*)::BIGINT AS n, {_R('avg(value)', 'mean')}, {_R('max(value)', 'most')} FROM events GROUP BY 1, 2",
}
QUERIES = {
    f.__name__: f
    for f in (
        calibration_ridge_oof, calibration_stability, calibration_three_way, calibration_changes, wide_matrix, rank_metrics, ridge_loso_univariate, holm_adjust, nested_ridge, permutation_null,
        jackknife, equalize_sample, random_split, model_grid, model_metrics, rf_range_audit, gate_checks, export_roundtrip, streaming_event_windows,
    )
}
