"""Ranking participants from wide features: design matrices, rank metrics, nested leave-one-out ridge by response weights.

Ridge predictions are linear in the labels, so the weights of all folds are computed once, whatever the labels; observed
predictions, permutations and selection are joins of weights with labels and sums.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order_statistics import kendall_cells
from .relational import ranked

ALPHAS = (0.1, 1.0, 10.0, 100.0)


def long_design(cells: DataFrame) -> DataFrame:
    """(participant, place, name, value) of the wide matrix, columns in the order of (gesture, feature)."""
    named = cells.select("participant", F.format_string("%02d:%s", "gesture", "feature").alias("name"), "value")
    place = F.dense_rank().over(Window.partitionBy("participant").orderBy("name"))
    return named.withColumn("place", place.cast("long"))


def rank_metrics(scored: DataFrame, keys: list[str], edges: tuple[float, float]) -> DataFrame:
    """n, Spearman, Kendall tau-b, MAE, RMSE and quadratic kappa of bands. scored: (keys, participant, truth, prediction)."""
    from ..functions.numeric import band

    r = ranked(scored.select(*keys, "truth", "prediction"), keys, ["truth", "prediction"])
    err = F.col("prediction") - F.col("truth")
    basic = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("rank_truth", "rank_prediction").alias("spearman"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"))
    tau = kendall_cells(scored, keys, "truth", "prediction")
    return basic.join(tau, keys, "left").join(kappa(scored.select(*keys, band("truth", edges).alias("a"), band("prediction", edges).alias("b")), keys), keys, "left")


def kappa(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Quadratic-weighted kappa; distances are between places among the labels that occur."""
    labels = bands.select(*keys, F.explode(F.array("a", "b")).alias("l")).distinct()
    placed = labels.withColumn("k", F.dense_rank().over(Window.partitionBy(*keys).orderBy("l")))
    side = lambda c: placed.select(*keys, F.col("l").alias(c), F.col("k").alias(f"k{c}"))
    rows = bands.join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"])
    d = F.col("ka") - F.col("kb")
    m = rows.groupBy(*keys).agg(F.avg(d * d).alias("seen"), F.avg("ka").alias("ma"), F.avg("kb").alias("mb"), F.var_pop("ka").alias("va"), F.var_pop("kb").alias("vb"))
    chance = F.col("va") + F.col("vb") + (F.col("ma") - F.col("mb")) * (F.col("ma") - F.col("mb"))
    return m.select(*keys, (1 - F.col("seen") / F.nullif(chance, F.lit(0.0))).alias("kappa"))


def holm(p: DataFrame, name: str, value: str) -> DataFrame:
    """Adds p_holm: step-down products, capped at 1, made monotone. A family of tests is a small table."""
    w = Window.orderBy(value, name)
    n, k = F.count(F.lit(1)).over(Window.partitionBy()), F.row_number().over(w)
    raw = F.least(F.lit(1.0), (n - k + 1) * F.col(value))
    return p.withColumn("_raw", raw).withColumn("p_holm", F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_raw")


def all_weights(train: np.ndarray, test: np.ndarray, alphas: tuple[float, ...]) -> np.ndarray:
    """(alpha, row): h with prediction h . y, of the standardised ridge with intercept. Columns are scaled once for all
    alphas; the intercept is the mean label: h is the ridge's share of each row plus an equal share of what is left of one."""
    spread = train.std(0)
    scaled = np.vstack([train, test]) - train.mean(0)
    scaled /= np.where(spread > 0, spread, 1.0)
    gram = scaled[:-1] @ scaled.T  # the last column belongs to the test
    penalty = np.multiply.outer(np.array(alphas), np.eye(len(train)))
    h = np.linalg.solve(gram[:, :-1] + penalty, np.broadcast_to(gram[:, -1:], (len(alphas), len(train), 1)))[..., 0]
    return h + (1 - h.sum(1, keepdims=True)) / len(train)


def dual_weights(train: np.ndarray, test: np.ndarray, alpha: float) -> np.ndarray:
    """The weights for one alpha."""
    return all_weights(train, test, (alpha,))[0]


def response_weights(matrix: DataFrame, alphas: tuple[float, ...] = ALPHAS, omit: bool = False) -> DataFrame:
    """(omitted, outer, alpha, held, participant, w): the weight of a participant's label in the prediction of ``held``,
    fitted without outer and held. held = outer is the outer prediction. matrix: (participant, x: array). Each outer fold is
    a group of its own; a study's participants are few, its features many. omit: also without each participant (jackknife)."""
    ids = matrix.select(F.col("participant").alias("outer")).distinct()
    folds = ids.withColumn("omitted", F.lit(None).cast("int"))
    if omit:
        other = ids.select(F.col("outer").cast("int").alias("omitted"))
        folds = ids.join(other, F.col("outer") != F.col("omitted")).select("outer", "omitted")
    rows = folds.join(matrix, F.col("omitted").isNull() | (F.col("participant") != F.col("omitted")))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("participant")
        outer, gone = group["outer"].iloc[0], group["omitted"].iloc[0]
        x, who = np.stack(group["x"].to_numpy()), group["participant"].to_numpy()
        out = []
        for held in who:
            keep = (who != outer) & (who != held)
            for a, h in zip(alphas, all_weights(x[keep], x[who == held][0], alphas)):
                out += [(gone, outer, a, held, p, w) for p, w in zip(who[keep], h)]
        return pd.DataFrame(out, columns=["omitted", "outer", "alpha", "held", "participant", "w"]).astype({"omitted": "Int32"})

    return rows.groupBy("outer", "omitted").applyInPandas(solve, "omitted int, outer int, alpha double, held int, participant int, w double")


def nested_predictions(weights: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, omitted, participant, truth, prediction, alpha). labels: (keys, participant, label), keys such as a permutation's number."""
    y = labels.select(*keys, "participant", "label")
    p = weights.join(y, "participant").groupBy(*keys, "omitted", "outer", "alpha", "held").agg(F.sum(F.col("w") * F.col("label")).alias("prediction"))
    t = labels.select(*keys, F.col("participant").alias("held"), F.col("label").alias("truth"))
    p = p.join(t, [*keys, "held"])
    loss = p.filter(F.col("held") != F.col("outer")).groupBy(*keys, "omitted", "outer", "alpha").agg(F.avg(F.abs(F.col("prediction") - F.col("truth"))).alias("loss"))
    best = loss.groupBy(*keys, "omitted", "outer").agg(F.min(F.struct(F.round("loss", 9).alias("loss"), "alpha")).alias("b")).select(*(F.col(k).alias(f"_{k}") for k in [*keys, "omitted", "outer"]), F.col("b.alpha").alias("_alpha"))
    final = p.filter(F.col("held") == F.col("outer"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "omitted", "outer", "alpha"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return final.join(best, on).select(*keys, "omitted", F.col("outer").alias("participant"), "truth", "prediction", "alpha")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows by key in as many partitions as a shuffle has: their bytes are few and their work isn't, so they aren't merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def fold_weights(x: np.ndarray, outer: int, alphas: tuple[float, ...] = ALPHAS) -> np.ndarray:
    """(alpha, held, participant): the weight of each label in the prediction of ``held`` by a fit without it and ``outer``."""
    size = len(x)
    w = np.zeros((len(alphas), size, size))
    for held in range(size):
        keep = np.setdiff1d(np.arange(size), [outer, held])
        w[:, held, keep] = all_weights(x[keep], x[held], alphas)
    return w


def _chosen(w: np.ndarray, y: np.ndarray, outer: int, alphas: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Predictions of ``outer`` and alphas per column of y: the least mean absolute error inside the fold, the first of ties."""
    p = w @ y
    inner = np.arange(len(y)) != outer
    best = np.abs(p[:, inner] - y[inner]).mean(1).argmin(0)
    return p[best, outer, np.arange(y.shape[1])], np.array(alphas)[best]


def permuted_predictions(matrix: DataFrame, labels: DataFrame, reps: int, seed: int, chunk: int = 1000) -> DataFrame:
    """(rep, participant, truth, prediction, alpha) of the nested ridge under labels dealt anew; rep 0 has them as they are.
    An outer fold is a group: its weights don't depend on the labels, so all replicates are products with them, in chunks.
    A replicate's order is drawn from its own seed, the same in every group."""
    rows = matrix.join(labels, "participant").select("participant", "x", "label")
    folds = rows.select(F.col("participant").alias("outer"))
    many = folds.join(rows, F.col("outer") != F.col("participant")).unionByName(rows.withColumn("outer", F.col("participant")))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("participant")
        who, y = group["participant"].to_numpy(), group["label"].to_numpy(float)
        outer = int(np.flatnonzero(who == group["outer"].iloc[0])[0])
        w, parts = fold_weights(np.stack(group["x"].to_numpy()), outer), []
        for first in range(0, reps + 1, chunk):
            some = range(first, min(first + chunk, reps + 1))
            dealt = np.stack([y[np.random.default_rng((seed, r)).permutation(len(y))] if r else y for r in some], 1)
            prediction, alpha = _chosen(w, dealt, outer, ALPHAS)
            parts.append(pd.DataFrame({"rep": list(some), "participant": who[outer], "truth": dealt[outer], "prediction": prediction, "alpha": alpha}))
        return pd.concat(parts)

    return _dealt(many, "outer").groupBy("outer").applyInPandas(solve, "rep int, participant int, truth double, prediction double, alpha double")


def replicate_predictions(matrices: DataFrame, labels: DataFrame) -> DataFrame:
    """(rep, participant, truth, prediction, alpha) of the nested ridge on each replicate's own matrix. matrices: (rep,
    participant, x). A replicate is a group of one row per participant; one of fewer than four participants has no rows."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("participant")
        x, y, out = np.stack(group["x"].to_numpy()), group["label"].to_numpy(float)[:, None], []
        for outer in range(len(x) if len(x) > 3 else 0):
            prediction, alpha = _chosen(fold_weights(x, outer), y, outer, ALPHAS)
            out.append((group["rep"].iloc[0], group["participant"].iloc[outer], y[outer, 0], prediction[0], alpha[0]))
        return pd.DataFrame(out, columns=["rep", "participant", "truth", "prediction", "alpha"])

    return _dealt(matrices.join(labels, "participant"), "rep").groupBy("rep").applyInPandas(solve, "rep int, participant int, truth double, prediction double, alpha double")
