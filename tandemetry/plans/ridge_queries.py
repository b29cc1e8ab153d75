"""Queries of the ridge over rows: leave-one-out, feature sets, random splits, equalised repetitions. None has SQL; the tests
hold them against plain loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import ranking as R
from ..operators import row_ridge as X
from ..operators.subsampling import drawn_sums, row_key
from ..sources import tables
from .model_queries import EDGES
from .views import FEATURES, table, target

SPLITS, EQUALIZATIONS, SEED = 200, 500, 20260815
#: Column lists of the variants: all, without the price, with the product of two, one alone.
SETS = {"primary": list(FEATURES), "without_price": ["quantity", "discount", "tax"], "with_product": [*FEATURES, "gross"], "low": ["quantity"]}
METRICS = ("spearman", "kendall", "mae", "rmse", "kappa")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant, gesture, sensor, key of the row, and the features about their sensor's means and in units of their
    deviations, so that no product cancels."""
    line = table(spark, sf_dir, "lineitem")
    line = line.select("l_suppkey", "l_linenumber", F.col("l_linestatus").alias("sensor"), row_key(*line.columns).alias("key"), *(F.col(f"l_{f}").alias(f) for f in FEATURES))
    line = line.withColumn("gross", F.col("quantity") * F.col("discount"))
    who = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("int").alias("participant"))
    columns = [*FEATURES, "gross"]
    scale = line.groupBy("sensor").agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"d_{c}") for c in columns))
    unit = [((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"d_{c}") > 0, F.col(f"d_{c}")).otherwise(1.0)).alias(c) for c in columns]
    # the scale is a row per sensor: a merge join would bring all rows of a sensor to one task
    return line.join(who, "l_suppkey").join(F.broadcast(scale), "sensor").select("participant", F.col("l_linenumber").alias("gesture"), "sensor", "key", *unit)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target(spark, sf_dir).select(F.col("participant").cast("int").alias("participant"), "label")


def _metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    return R.rank_metrics(tables.written(scored.select(*keys, "participant", "truth", "prediction"), "scored"), keys, EDGES)


def long_loso_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each participant's label from its rows' mean prediction, by rows of the others; per sensor."""
    out = X.leave_one_out(X.moments(rows(spark, sf_dir), ["sensor", "participant"], SETS["primary"]), _labels(spark, sf_dir), ["sensor"])
    return out.select("sensor", "participant", r6("truth").alias("truth"), r6("prediction").alias("prediction"), "alpha")


def feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank metrics of the ridge over rows for each set of columns and sensor."""
    data, labels, out = tables.written(rows(spark, sf_dir), "rows"), _labels(spark, sf_dir), None
    for name, columns in SETS.items():
        part = X.leave_one_out(X.moments(data, ["sensor", "participant"], columns), labels, ["sensor"]).withColumn("set", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return _metrics(out, ["set", "sensor"]).select("set", "sensor", "n", *(r6(c).alias(c) for c in METRICS))


def split(data: DataFrame, reps: int, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Moments by sensor, replicate and participant of the rows kept and of those held: 30 per cent, one at least, drawn
    without replacement. The kept ones are the whole less the held."""
    keys = ["sensor", "participant"]
    whole = tables.written(X.moments(data, keys, columns), "whole")
    cells = whole.select(*keys, F.greatest(F.lit(1).cast("long"), F.bround(F.col("n") * 0.3).cast("long")).alias("k"))
    held = tables.written(drawn_sums(data.select(*keys, "key", *columns), cells, keys, "key", columns, reps, SEED), "held")
    less = lambda c: F.zip_with(c, f"_{c}", lambda a, b: a - b).alias(c)
    all_ = whole.select(*keys, "n", "s", "q")
    both = held.select(*keys, "rep", *(F.col(c).alias(f"_{c}") for c in "nsq")).join(all_, keys).filter(F.col("n") > F.col("_n"))
    return both.select(*keys, "rep", (F.col("n") - F.col("_n")).alias("n"), less("s"), less("q")), held


def random_split_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sensor and replicate the metrics of participants' mean predictions over held rows, by a ridge on the other rows."""
    keys = ["sensor", "rep"]
    train, test = split(rows(spark, sf_dir).dropna(subset=SETS["primary"]), SPLITS, SETS["primary"])
    scored = X.held_rows(train, test, _labels(spark, sf_dir), keys)
    sizes = test.groupBy(*keys).agg(F.sum("n").alias("held_rows"))
    return _metrics(scored, keys).join(sizes, keys).select(*keys, "held_rows", "n", *(r6(c).alias(c) for c in METRICS))


def equalized(data: DataFrame, reps: int) -> DataFrame:
    """(rep, participant, x): means per gesture of the reference sensor's rows, as many of a cell as the other sensor has."""
    keys, columns = ["participant", "gesture"], list(FEATURES)
    count = lambda s: F.count_if(F.col("sensor") == s)
    cells = data.groupBy(*keys).agg(F.least(count("F"), count("O")).alias("k")).filter("k > 0")
    drawn = drawn_sums(data.filter(F.col("sensor") == "F").select(*keys, "key", *columns), cells, keys, "key", columns, reps, SEED, products=False)
    means = drawn.select("rep", "participant", F.struct("gesture", F.transform("s", lambda v: v / F.col("n")).alias("m")).alias("c"))
    wide = means.groupBy("rep", "participant").agg(F.sort_array(F.collect_list("c")).alias("c"))  # seven at most
    return wide.filter(F.size("c") == 7).select("rep", "participant", F.flatten(F.transform("c", lambda c: c["m"])).alias("x"))


def equalized_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per replicate the metrics of the nested ridge on equalised cell means, and how often each alpha is chosen."""
    data = rows(spark, sf_dir).dropna(subset=list(FEATURES))
    scored = tables.written(R.replicate_predictions(equalized(data, EQUALIZATIONS), _labels(spark, sf_dir)), "equalized")
    alphas = scored.groupBy("rep").agg(*(F.count_if(F.col("alpha") == a).alias(f"alpha_{i}") for i, a in enumerate(R.ALPHAS)))
    return _metrics(scored, ["rep"]).join(alphas, "rep").select("rep", "n", *(r6(c).alias(c) for c in METRICS), *(f"alpha_{i}" for i in range(len(R.ALPHAS))))


SQL: dict[str, str] = {}
QUERIES = {f.__name__: f for f in (long_loso_ridge, feature_sets, random_split_ridge, equalized_ridge)}
