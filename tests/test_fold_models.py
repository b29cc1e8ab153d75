"""Trees, boosting and elastic nets against plain loops; selection inside the folds; ranges."""

import numpy as np
import pytest

from tandemetry.operators import fold_models as M
from tandemetry.operators import trees as T
from tandemetry.operators.ranking import all_weights

EDGES = (0.5, 1.5)


def plain_tree(x, y, w, point, depth, penalty=0.0):
    """One tree, node by node: the value of the leaf of ``point``."""
    some = w > 0
    value = (w * y).sum() / (w.sum() + penalty)
    spread = (w * y * y).sum() - (w * y).sum() ** 2 / w.sum()
    if depth == 0 or spread <= 1e-12 * max(1.0, (w * y * y).sum()):
        return value
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[some, f])
        for a, b in zip(values, values[1:]):
            left = x[:, f] <= a
            sides = [(w * y * s).sum() ** 2 / ((w * s).sum() + penalty) for s in (left, ~left)]
            if best is None or sum(sides) > best[0] + 1e-9:
                best = sum(sides), f, (a + b) / 2
    if best is None or (penalty and best[0] - (w * y).sum() ** 2 / (w.sum() + penalty) <= 1e-12):
        return value
    _, f, cut = best
    side = (x[:, f] <= cut) == (point[f] <= cut)
    return plain_tree(x, y, w * side, point, None if depth is None else depth - 1, penalty)


def data(seed, rows=18, features=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(rows, features)), 1)  # ties among values
    return x, x[:, 0] * 2 + np.abs(x[:, 1]) + rng.normal(size=rows) * 0.3, rng


@pytest.mark.parametrize(("depth", "penalty"), [(1, 0.0), (3, 0.0), (None, 0.0), (2, 1.0), (3, 1.0)])
def test_trees_grow_as_a_plain_grower(depth, penalty):
    for seed in range(4):
        x, y, rng = data(seed)
        w = rng.integers(0, 3, (25, len(y))).astype(float)
        rows = rng.integers(0, len(y), 25)
        w[np.arange(25), rows] = 0
        label = T.grow(x, w, np.broadcast_to(y, w.shape), depth, penalty)
        got = T.leaf_means(label, w, np.broadcast_to(y, w.shape), rows, penalty)
        want = [plain_tree(x, y, w[i], x[r], depth, penalty) for i, r in enumerate(rows)]
        assert got == pytest.approx(want, abs=1e-9)


def test_forest_keeps_to_its_labels_and_to_a_share_of_features():
    x, y, _ = data(1)
    train = np.arange(len(y)) > 1
    for depth, share in ((3, 0.7), (None, 1.0)):
        for row in (0, 1):
            p = T.forest(x, y, train, row, 50, depth, share, np.random.default_rng(1))
            assert y[train].min() <= p <= y[train].max()
            assert p == T.forest(x, y, train, row, 50, depth, share, np.random.default_rng(1))
            shifted = y.copy()
            shifted[~train] += 100  # what isn't in the training set has no say
            assert p == pytest.approx(T.forest(x, shifted, train, row, 50, depth, share, np.random.default_rng(1)))
    one = T.grow(x, np.ones((40, len(y))), np.broadcast_to(y, (40, len(y))), 1, share=0.25, rng=np.random.default_rng(0))
    assert len({tuple(r) for r in one}) > 1


def test_boosting_against_a_plain_loop():
    x, y, rng = data(2)
    train = np.ones((3, len(y)), bool)
    for i in range(3):
        train[i, i] = False
    drawn = rng.random((3, 12, len(y))) < 0.8
    got = T.boosted(x, y, train, np.arange(3), drawn, 2, 0.1, 1.0)
    for i in range(3):
        fitted = np.full(len(y), y[train[i]].mean())
        for r in range(12):
            w = (drawn[i, r] & train[i]).astype(float)
            fitted = fitted + 0.1 * np.array([plain_tree(x, y - fitted, w, p, 2, 1.0) for p in x])
        assert got[i] == pytest.approx(fitted[i], abs=1e-9)


@pytest.mark.parametrize("setting", M.CANDIDATES["elastic_net"])
def test_elastic_net_is_the_minimum(setting):
    alpha, mix = setting
    x, y, _ = data(3, 20, 30)  # more columns than rows
    m = M.Moments(x, y)
    n, mean, sd, gram, xy = m.without([4, 7])
    keep = np.setdiff1d(np.arange(20), [4, 7])
    z, v = (x[keep] - x[keep].mean(0)) / x[keep].std(0), y[keep] - y[keep].mean()
    assert gram == pytest.approx(z.T @ z, abs=1e-9) and xy == pytest.approx(z.T @ v, abs=1e-9)
    w = M.elastic_net(gram[None], xy[None], np.array([float(n)]), alpha, mix, np.zeros((1, 30)))[0]
    slope = z.T @ (v - z @ w) / n - alpha * (1 - mix) * w  # the conditions of the minimum
    assert np.abs(slope[w != 0] - alpha * mix * np.sign(w[w != 0])).max(initial=0) < 1e-8
    assert np.abs(slope[w == 0]).max(initial=0) <= alpha * mix + 1e-8
    loss = lambda u: ((v - z @ u) ** 2).sum() / (2 * n) + alpha * (mix * np.abs(u).sum() + (1 - mix) * (u * u).sum() / 2)
    rng = np.random.default_rng(0)
    assert all(loss(w) <= loss(w + rng.normal(size=30) * s) + 1e-8 for s in (1e-6, 1e-3, 1e-1) for _ in range(20))


SMALL = {"ridge": [0.1, 10.0], "elastic_net": M.CANDIDATES["elastic_net"], "forest": [(15, 2, 0.7), (15, None, 1.0)], "ordinal": [1.0], "boosted": [(8, 2, 0.3, 0.8), (12, 3, 0.3, 0.8)]}


def test_selection_inside_the_folds(spark):
    x, y, _ = data(5, 7)
    rows = [(s, i, (x[i] * (1 + k)).tolist(), float(y[i])) for k, s in enumerate("FO") for i in range(7)]
    rows += [("F", 90, None, 1.0), ("F", 91, [1.0, None, 1.0, 1.0], 1.0), ("F", 92, [1.0] * 4, None), ("Z", 1, [1.0] * 4, 2.0)]
    design = spark.createDataFrame(rows, "sensor string, participant int, x array<double>, label double")
    found = M.predictions(design, ["sensor"], EDGES, SMALL).collect()
    assert len(found) == 2 * 7 * 7 * 10 and {r.sensor for r in found} == {"F", "O"}
    at = {(r.sensor, r.model, r.candidate, r.outer, r.held): r for r in found}
    again = {(r.sensor, r.model, r.candidate, r.outer, r.held): r.prediction for r in M.predictions(design.repartition(5), ["sensor"], EDGES, SMALL).collect()}
    assert all(again[k] == pytest.approx(r.prediction, abs=1e-9) for k, r in at.items())  # however folds are dealt
    for (sensor, model, c, o, h), r in at.items():
        train = np.setdiff1d(np.arange(7), [o, h])
        assert (r.low, r.high, r.truth) == (y[train].min(), y[train].max(), y[h])
        if model == "forest":
            assert r.low - 1e-12 <= r.prediction <= r.high + 1e-12
        if model == "ridge":
            z = x * (1 if sensor == "F" else 2)
            assert r.prediction == pytest.approx(float(all_weights(z[train], z[h], (SMALL["ridge"][c],))[0] @ y[train]), abs=1e-9)
    for r in M.nested(design, ["sensor"], EDGES, SMALL).collect():
        count = len(SMALL[r.model])
        losses = [np.mean([abs(at[r.sensor, r.model, c, r.participant, h].prediction - y[h]) for h in range(7) if h != r.participant]) for c in range(count)]
        assert r.loss == pytest.approx(min(losses)) and losses[r.candidate] == pytest.approx(min(losses))
        assert r.prediction == pytest.approx(at[r.sensor, r.model, r.candidate, r.participant, r.participant].prediction)


def test_empty_design(spark):
    none = spark.createDataFrame([], "sensor string, participant int, x array<double>, label double")
    assert M.nested(none, ["sensor"], EDGES, SMALL).count() == 0
