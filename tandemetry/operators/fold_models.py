"""Five models with their settings chosen inside the folds, for all folds of a study at once.

Each fold is one row: an outer participant, a held one, and the study's design; held = outer is the outer fit, any other an
inner one. A study's participants are few, and a fit needs all of them, so a design is one row of arrays; folds are made by
exploding it twice (no join), dealt out evenly and fitted where they land. Predictions of all candidates come back as rows;
which candidate an outer fold uses is a grouping of its inner losses.

Elastic nets descend along coordinates of Gram matrices: a fold's moments are the study's less those of the two participants
it leaves out, and each candidate starts where the one before ended. Forests and boosted trees grow by ``trees``; they are
seeded by fold and candidate and aren't bit-identical to other libraries'.

Defined results: a participant with a null feature or label takes no part; a study of fewer than four participants gives no
rows; of candidates with equal losses the first is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import with_package, written
from .models import ordinal_fits
from .ranking import all_weights
from .trees import boosted, forest

#: The settings from which a fold chooses.
CANDIDATES = {
    "ridge": [0.1, 1.0, 10.0, 100.0],
    "elastic_net": [(0.01, 0.2), (0.1, 0.5), (1.0, 0.8)],
    "forest": [(300, 3, 0.7), (300, None, 1.0)],
    "ordinal": [0.1, 1.0, 10.0],
    "boosted": [(100, 2, 0.03, 0.8), (150, 3, 0.03, 0.8)],
}
LEAF_PENALTY = 1.0


def elastic_net(gram: np.ndarray, xy: np.ndarray, n: np.ndarray, alpha: float, mix: float, start: np.ndarray, most: int = 20_000, within: float = 1e-11) -> np.ndarray:
    """The minima of |y - Xw|^2 / 2n + alpha (mix |w|_1 + (1 - mix) |w|^2 / 2) for several sets at once, by coordinate descent.
    gram: (set, column, column), X'X; xy: (set, column), X'y; n: (set,); start: (set, column). A set that has settled is left alone."""
    w = start.copy()
    lasso, ridge, todo = alpha * mix, alpha * (1 - mix), np.arange(len(w))
    q, r = gram / n[:, None, None], xy / n[:, None]
    for _ in range(most):
        part, some = w[todo], q[todo]
        slope = r[todo] - np.einsum("sij,sj->si", some, part)
        moved = np.zeros(len(todo))
        for j in range(w.shape[1]):
            own = some[:, j, j]
            rho = slope[:, j] + own * part[:, j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - lasso, 0.0) / np.where(own + ridge > 0, own + ridge, 1.0)
            step = new - part[:, j]
            slope -= some[:, :, j] * step[:, None]
            part[:, j] = new
            moved = np.maximum(moved, np.abs(step))
        w[todo] = part
        todo = todo[moved > within * np.maximum(1.0, np.abs(part).max(1))]
        if not len(todo):
            break
    return w


class Moments:
    """Numbers, sums and products of a study's columns and labels, of which participants' own can be taken off."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.shift = np.append(x.mean(0), y.mean())  # near zero, or the products cancel
        self.z = np.column_stack([x, y]) - self.shift
        self.total, self.products = self.z.sum(0), self.z.T @ self.z

    def without(self, gone: list[int]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n, means and deviations of the columns and the label's mean, Gram matrix and products with the label, standardised."""
        n, d = len(self.z) - len(gone), self.z.shape[1] - 1
        s = self.total - self.z[gone].sum(0)
        q = self.products - self.z[gone].T @ self.z[gone] - np.outer(s, s) / n
        var = np.diag(q)[:d] / n
        sd = np.sqrt(np.where(var > 1e-13 * np.maximum(1.0, (s[:d] / n) ** 2), var, 1.0))
        return n, self.shift + s / n, sd, q[:d, :d] / np.outer(sd, sd), q[:d, d] / sd


def nets(moments: Moments, gone: list[list[int]], points: np.ndarray, settings: list) -> np.ndarray:
    """(candidate, set): predictions at points (set, column) of fits without the rows in ``gone``."""
    n, mean, sd, gram, xy = (np.array(v) for v in zip(*(moments.without(g) for g in gone)))
    w, out = np.zeros(xy.shape), []
    for alpha, mix in settings:
        w = elastic_net(gram, xy, n.astype(float), alpha, mix, w)
        out.append(mean[:, -1] + ((points - mean[:, :-1]) / sd * w).sum(1))
    return np.array(out)


def ordinals(x: np.ndarray, y: np.ndarray, train: np.ndarray, points: np.ndarray, settings: list, edges: tuple[float, float]) -> np.ndarray:
    """(candidate, set): class probabilities times the classes' mean labels; a class without rows has the mean of all.
    train: (set, row)."""
    t = train.astype(float)
    size = t.sum(1, keepdims=True)
    mean = t @ x / size
    var = t @ (x * x) / size - mean**2
    sd = np.sqrt(np.where(var > 1e-13 * np.maximum(1.0, mean**2), var, 1.0))
    z = (x - mean[:, None]) / sd[:, None] * t[..., None]
    k, classes = np.searchsorted(np.array(edges), y, side="left"), len(edges) + 1
    members = t[:, None, :] * (k == np.arange(classes)[:, None])
    centres = np.where(members.sum(2) > 0, members @ y / np.maximum(members.sum(2), 1), (t @ y)[:, None] / size)
    out = []
    for penalty in settings:
        w, cut = ordinal_fits(z, k, train, classes, penalty)
        below = 1 / (1 + np.exp(-np.clip(cut - ((points - mean) / sd * w).sum(1, keepdims=True), -500, 500)))
        ends = np.zeros((len(t), 1))
        out.append((np.diff(np.hstack([ends, below, ends + 1])) * centres).sum(1))
    return np.array(out)


def folds(design: DataFrame, keys: list[str], inner: bool = True) -> DataFrame:
    """(keys, outer, held, who, x, y): a row per outer and held participant with the study's arrays. design: (keys, participant, x, label)."""
    whole = design.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", F.isnull))
    rows = whole.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("participant", "x", F.col("label").cast("double").alias("label")))).alias("p"))
    rows = rows.filter(F.size("p") > 3).withColumn("o", F.explode(F.sequence(F.lit(0), F.size("p") - 1)))
    rows = rows.withColumn("h", F.explode(F.sequence(F.lit(0), F.size("p") - 1)) if inner else F.col("o"))
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.select(*keys, "o", "h", F.col("p.participant").alias("who"), F.col("p.x").alias("x"), F.col("p.label").alias("y")).repartition(tasks, *keys, "o", "h")


def predictions(design: DataFrame, keys: list[str], edges: tuple[float, float], models: dict[str, list] = CANDIDATES, seed: int = 20260815, inner: bool = True) -> DataFrame:
    """(keys, model, candidate, outer, held, truth, prediction, low, high): every fold's prediction of its held participant by
    every candidate, with the range of its training labels."""
    with_package(design.sparkSession)
    kind = design.schema["participant"].dataType.simpleString()
    schema = "".join(f"{k} {design.schema[k].dataType.simpleString()}, " for k in keys) + f"model string, candidate int, outer {kind}, held {kind}, truth double, prediction double, low double, high double"

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, some in batch.groupby(keys or (lambda _: 0), dropna=False):
                x, y, who = np.array(some["x"].iloc[0].tolist(), float), np.array(some["y"].iloc[0], float), some["who"].iloc[0]
                moments, sets = Moments(x, y), list(zip(some["o"], some["h"]))
                train = np.ones((len(sets), len(y)), bool)
                for i, pair in enumerate(sets):
                    train[i, list(pair)] = False
                points, found = x[[h for _, h in sets]], {}
                if "ridge" in models:
                    found["ridge"] = np.array([all_weights(x[t], p, tuple(models["ridge"])) @ y[t] for t, p in zip(train, points)]).T
                if "elastic_net" in models:
                    found["elastic_net"] = nets(moments, [sorted(set(s)) for s in sets], points, models["elastic_net"])
                if "ordinal" in models:
                    found["ordinal"] = ordinals(x, y, train, points, models["ordinal"], edges)
                for name in ("forest", "boosted"):
                    found |= {name: np.zeros((len(models[name]), len(sets)))} if name in models else {}
                for j, setting in enumerate(models.get("forest", [])):
                    found["forest"][j] = [forest(x, y, train[i], h, *setting, np.random.default_rng([seed, o, h, j])) for i, (o, h) in enumerate(sets)]
                for j, (rounds, depth, rate, keep) in enumerate(models.get("boosted", [])):  # all sets grow together, each with draws of its own
                    drawn = np.stack([np.random.default_rng([seed, o, h, j]).random((rounds, len(y))) < keep for o, h in sets])
                    found["boosted"][j] = boosted(x, y, train, np.array([h for _, h in sets]), drawn, depth, rate, LEAF_PENALTY)
                fixed = key if isinstance(key, tuple) else (key,)
                for i, (o, h) in enumerate(sets):
                    ends = y[train[i]].min(), y[train[i]].max()
                    out += [(*fixed[: len(keys)], model, c, who[o], who[h], y[h], v[i], *ends) for model, values in found.items() for c, v in enumerate(values)]
            yield pd.DataFrame(out, columns=[*keys, "model", "candidate", "outer", "held", "truth", "prediction", "low", "high"])

    return folds(design, keys, inner).mapInPandas(fit, schema)


def nested(design: DataFrame, keys: list[str], edges: tuple[float, float], models: dict[str, list] = CANDIDATES, seed: int = 20260815) -> DataFrame:
    """(keys, model, participant, truth, prediction, candidate, loss, low, high): each participant predicted by a fit without
    it, with the candidate of the least mean absolute error among fits that leave one more participant out."""
    found = written(predictions(design, keys, edges, models, seed), "folds")
    group = [*keys, "model", "outer"]
    loss = found.filter(F.col("held") != F.col("outer")).groupBy(*group, "candidate").agg(F.avg(F.abs(F.col("prediction") - F.col("truth"))).alias("loss"))
    best = loss.groupBy(*group).agg(F.min(F.struct("loss", "candidate")).alias("b")).select(*group, "b.candidate", "b.loss")
    final = found.filter(F.col("held") == F.col("outer")).drop("held")
    return final.join(best, [*group, "candidate"]).withColumnRenamed("outer", "participant")
