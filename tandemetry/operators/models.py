"""The ordinal logit, and the audit of predictions' ranges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_violations(predictions: DataFrame) -> DataFrame:
    """Per model the predictions outside the training labels' range, with the least margins; trees can't leave it."""
    bad = (F.col("prediction") < F.col("train_low") - 1e-12) | (F.col("prediction") > F.col("train_high") + 1e-12)
    return predictions.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("violations"), F.min(F.col("prediction") - F.col("train_low")).alias("low_margin"), F.min(F.col("train_high") - F.col("prediction")).alias("high_margin"))


def ordinal_fits(x: np.ndarray, k: np.ndarray, train: np.ndarray, classes: int, penalty: float = 1.0, steps: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """All-threshold logits of several training sets at once: weights (set, column) and increasing thresholds, by accelerated
    gradient descent. x: (set, row, column), zero where a row isn't in ``train`` (set, row); k: the rows' classes."""
    w, cut = np.zeros((len(x), x.shape[2])), np.tile(np.linspace(-1, 1, classes - 1), (len(x), 1))
    side = np.where(k[:, None] <= np.arange(classes - 1), 1.0, -1.0) * train[..., None]
    norms = np.linalg.norm(x, 2, axis=(1, 2)) ** 2 + train.sum(1)
    rate, vw, vc = (1.0 / (0.25 * norms * (classes - 1) + penalty))[:, None], np.zeros_like(w), np.zeros_like(cut)
    flipped = np.ascontiguousarray(x.transpose(0, 2, 1))
    for i in range(steps):
        m = i / (i + 3)
        yw, yc = w + m * vw, cut + m * vc
        g = -side / (1 + np.exp(np.clip(side * (yc[:, None, :] - x @ yw[..., None]), -500, 500)))
        nw, nc = yw - rate * (penalty * yw - (flipped @ g.sum(2, keepdims=True))[..., 0]), yc - rate * g.sum(1)
        vw, vc, w, cut = nw - w, nc - cut, nw, nc
    return w, np.sort(cut, 1)


def ordinal_fit(x: np.ndarray, k: np.ndarray, classes: int, penalty: float = 1.0, steps: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """``ordinal_fits`` of one set of rows."""
    w, cut = ordinal_fits(x[None], k, np.ones((1, len(x)), bool), classes, penalty, steps)
    return w[0], cut[0]
