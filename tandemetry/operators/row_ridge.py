"""Ridge over rows, judged by participants' mean predictions, from additive moments.

A participant's rows enter a fit only through their number, sums and products, so a training set without a participant
is the total less its moments: no fold ever reads the rows again. Moments are aggregated by Spark; the fits of one
replicate are a group of one row per participant.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ALPHAS


def moments(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n, s: array of sums, q: flat matrix of the products' sums). Rows with a null column are left out. Columns
    should lie near zero, or the products cancel."""
    d = len(columns)
    full = rows.dropna(subset=columns)
    sums = [F.sum(c) for c in columns]
    upper = {(i, j): F.sum(F.col(columns[i]) * F.col(columns[j])) for i in range(d) for j in range(i, d)}
    flat = [upper[min(i, j), max(i, j)] for i in range(d) for j in range(d)]
    return full.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("s"), F.array(*flat).alias("q"))


def _fit(n, s, q, y, means, alphas) -> np.ndarray:
    """Predictions at ``means`` (k, d) for each alpha, of the ridge on participants with moments n, s, q and labels y."""
    total = n.sum()
    mu, centre = s.sum(0) / total, (n @ y) / total
    cov = q.sum(0) / total - np.outer(mu, mu)
    var = np.diag(cov)
    sd = np.sqrt(np.where(var <= 1e-12 * np.maximum(1.0, mu**2), 1.0, var))
    r = cov / np.outer(sd, sd) * total
    v = (s.T @ y - total * mu * centre) / sd
    z = (means - mu) / sd
    return np.stack([centre + z @ np.linalg.solve(r + a * np.eye(len(v)), v) for a in alphas])


def chosen_alpha(n, s, q, y, alphas=ALPHAS) -> float:
    """The alpha with the least mean absolute error of participants' mean predictions, each left out; the first of ties."""
    errors = np.zeros(len(alphas))
    for i in range(len(n)):
        rest = np.arange(len(n)) != i
        errors += np.abs(_fit(n[rest], s[rest], q[rest], y[rest], s[i] / n[i], alphas) - y[i])
    return alphas[int(errors.argmin())]


def _unpacked(group: pd.DataFrame, tail: str = ""):
    s = np.stack(group["s" + tail].to_numpy())
    return group["n" + tail].to_numpy(float), s, np.stack(group["q" + tail].to_numpy()).reshape(len(s), s.shape[1], s.shape[1])


_SCORED = "participant int, truth double, prediction double, alpha double"


def leave_one_out(sums: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, participant, truth, prediction, alpha): each participant's mean prediction by a fit without it, alpha chosen
    without it too. sums: ``moments`` by keys and participant. Fewer than three participants: no rows."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("participant")
        n, s, q = _unpacked(group)
        y, out = group["label"].to_numpy(float), []
        for i in range(len(n) if len(n) > 2 else 0):
            rest = np.arange(len(n)) != i
            a = chosen_alpha(n[rest], s[rest], q[rest], y[rest])
            out.append((*group[keys].iloc[0], group["participant"].iloc[i], y[i], _fit(n[rest], s[rest], q[rest], y[rest], s[i] / n[i], [a])[0], a))
        return pd.DataFrame(out, columns=[*keys, "participant", "truth", "prediction", "alpha"])

    joined = sums.join(labels, "participant")
    kinds = "".join(f"{k} {joined.schema[k].dataType.simpleString()}, " for k in keys)
    return joined.groupBy(*keys).applyInPandas(solve, kinds + _SCORED)


def held_rows(train: DataFrame, test: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, participant, truth, prediction, alpha): participants' mean predictions over their held rows by a fit on all
    participants' other rows. train, test: ``moments`` by keys and participant. A participant without training rows is
    predicted by the others; one without held rows is left out."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("participant")
        fit = group[group["n"].notna()]
        if len(fit) < 2:
            return pd.DataFrame([], columns=[*keys, "participant", "truth", "prediction", "alpha"])
        n, s, q = _unpacked(fit)
        a = chosen_alpha(n, s, q, fit["label"].to_numpy(float))
        means = np.stack(group["s_held"].to_numpy()) / group["n_held"].to_numpy(float)[:, None]
        out = group[[*keys, "participant"]].assign(truth=group["label"], alpha=a)
        out["prediction"] = _fit(n, s, q, fit["label"].to_numpy(float), means, [a])[0]
        return out

    held = test.select(*keys, "participant", F.col("n").alias("n_held"), F.col("s").alias("s_held"))
    joined = held.join(train, [*keys, "participant"], "left").join(labels, "participant")
    kinds = "".join(f"{k} {joined.schema[k].dataType.simpleString()}, " for k in keys)
    return joined.groupBy(*keys).applyInPandas(solve, kinds + _SCORED)
