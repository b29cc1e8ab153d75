"""Regression trees grown level by level, many at once, from running sums over sorted features.

A batch of trees shares its rows and differs in the rows' weights and targets: bootstrap counts of a forest, residuals of
boosting rounds, training sets of folds. A level is worked off for all open nodes of all trees together: a node's members
are laid out in the order of every feature, and weights and weighted targets summed up along it give the gain of all splits
at once. Nodes are padded to the next power of two of their members, so a level costs trees x rows x features, however many
nodes there are. A split lies between two values that occur in the node, at their middle. Rows of weight 0 don't take part
but are sent down the trees, so the prediction for a row that a tree never saw is the value of the node where it ends.
"""

from __future__ import annotations

import numpy as np

#: A batch's trees are so few that a level has so many entries at most; no tree is deeper than labels of nodes allow.
ENTRIES, DEEPEST = 2_000_000, 60


def _splits(x: np.ndarray, rank: np.ndarray, members: np.ndarray, w: np.ndarray, t: np.ndarray, penalty: float, taken: int, rng: np.random.Generator | None) -> tuple[np.ndarray, np.ndarray]:
    """Of nodes with members (node, place), padded by -1, weights and targets alike: which are split, and which members go right."""
    nodes, size = members.shape
    features = x.shape[1]
    sums = w * t
    total, s = w.sum(1), sums.sum(1)
    square = (sums * t).sum(1)
    open_ = square - s * s / np.where(total > 0, total, 1) > 1e-12 * np.maximum(1.0, square)
    bits = size.bit_length() - 1  # of a power of two
    ranks = np.take(np.vstack([rank, np.full(features, len(x))]).astype(np.int32), members, 0).transpose(0, 2, 1)  # -1 is the last
    code = (ranks << bits) + np.arange(size, dtype=np.int32)
    code.sort(2)  # (node, feature, place): ranks in order, each with the place it came from
    at, ordered = (code & (size - 1)) + (np.arange(nodes, dtype=np.int32) * size)[:, None, None], code >> bits
    lw, ls = np.take(w.ravel(), at).cumsum(2), np.take(sums.ravel(), at).cumsum(2)
    rw, rs = total[:, None, None] - lw, s[:, None, None] - ls
    valid = (lw > 1e-9) & (rw > 1e-9) & open_[:, None, None]
    valid[:, :, :-1] &= ordered[:, :, 1:] > ordered[:, :, :-1]
    valid[:, :, -1] = False
    if taken < features:
        draw = rng.random((nodes, features))
        valid &= (draw <= np.partition(draw, taken - 1, 1)[:, taken - 1 : taken])[..., None]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(valid, ls * ls / (lw + penalty) + rs * rs / (rw + penalty), -1e300).reshape(nodes, -1)
    top = score.max(1, keepdims=True)
    best = (score >= top - 1e-9 * np.maximum(1.0, np.abs(top))).argmax(1)  # of equal splits the first, whatever rounding says
    gain = top[:, 0] - (s * s / np.where(total > 0, total + penalty, 1) if penalty else 0)
    cut = (top[:, 0] > -1e299) & ((gain > 1e-12) if penalty else True)
    feature = best // size
    border = ordered[np.arange(nodes), feature, best % size]
    values, places = x[members, feature[:, None]], rank[members, feature[:, None]]
    low = np.where((places <= border[:, None]) & (w > 0), values, -np.inf).max(1)
    high = np.where((places > border[:, None]) & (w > 0), values, np.inf).min(1)
    with np.errstate(invalid="ignore"):
        middle = low + (high - low) / 2
    return cut, values > np.where(middle < high, middle, low)[:, None]


def grow(x: np.ndarray, weights: np.ndarray, targets: np.ndarray, depth: int | None, penalty: float = 0.0, share: float = 1.0, rng: np.random.Generator | None = None, sent: np.ndarray | None = None) -> np.ndarray:
    """(tree, row): the node in which each row ends. x: (row, feature); weights, targets: (tree, row). depth None: until nodes
    are pure. penalty: added to a side's weight in its score S^2 / (W + penalty); with one, a split must gain something.
    share: of features that a node may split by, drawn with rng for each node. sent: the rows (tree, row) whose ends are
    asked for; all by default."""
    features = x.shape[1]
    rank = np.stack([np.unique(c, return_inverse=True)[1] for c in x.T], 1)
    label = np.ones(weights.shape, np.int64)
    tree, row = np.nonzero((weights > 0) | (True if sent is None else sent))
    for _ in range(DEEPEST if depth is None else min(depth, DEEPEST)):
        if not len(tree):
            break
        order = np.lexsort((row, label[tree, row], tree))
        tree, row = tree[order], row[order]
        new = np.append(True, (np.diff(tree) != 0) | (np.diff(label[tree, row]) != 0))
        first, node = np.flatnonzero(new), new.cumsum() - 1
        count = np.diff(np.append(first, len(tree)))
        going = np.zeros(len(tree), bool)
        width = 2 ** np.ceil(np.log2(np.maximum(count, 2))).astype(int)
        for size in map(int, np.unique(width)):
            some = np.flatnonzero((width == size) & (count > 1))
            if not len(some):
                continue
            place = first[some, None] + np.arange(size)
            real = np.arange(size) < count[some, None]
            place = np.where(real, place, 0)
            members = np.where(real, row[place], -1)
            owner = tree[first[some], None]
            w = np.where(real, weights[owner, row[place]], 0.0)
            t = np.where(real, targets[owner, row[place]], 0.0)
            cut, right = _splits(x, rank, members, w, t, penalty, max(1, int(share * features)), rng)
            moved = real & cut[:, None]
            at = place[moved]
            label[tree[at], row[at]] = 2 * label[tree[at], row[at]] + right[moved]
            going[at] = True
        tree, row = tree[going], row[going]
    return label


def leaf_means(label: np.ndarray, weights: np.ndarray, targets: np.ndarray, row: np.ndarray, penalty: float = 0.0) -> np.ndarray:
    """(tree,): the value S / (W + penalty) of the node in which each tree's own ``row`` ended."""
    same = (label == np.take_along_axis(label, row[:, None], 1)) * weights
    return (same * targets).sum(1) / (same.sum(1) + penalty)


def forest(x: np.ndarray, y: np.ndarray, train: np.ndarray, row: int, trees: int, depth: int | None, share: float, rng: np.random.Generator) -> float:
    """A forest's prediction of one row: bootstrap samples of the rows in ``train``, a share of the features at each node."""
    some = np.flatnonzero(train)
    draws = rng.integers(0, len(some), (trees, len(some)))
    weights = np.zeros((trees, len(y)))
    np.add.at(weights, (np.arange(trees)[:, None], some[draws]), 1.0)
    targets = np.broadcast_to(y - y[some].mean(), weights.shape)
    step, sent, out = max(1, ENTRIES // x.size), np.arange(len(y)) == row, []
    for a in range(0, trees, step):
        w, t = weights[a : a + step], targets[a : a + step]
        out.append(leaf_means(grow(x, w, t, depth, share=share, rng=rng, sent=np.broadcast_to(sent, w.shape)), w, t, np.full(len(w), row)))
    low, high = y[some].min(), y[some].max()
    return float(np.clip(np.concatenate(out).mean() + y[some].mean(), low, high))  # what rounding adds is taken off


def boosted(x: np.ndarray, y: np.ndarray, train: np.ndarray, rows: np.ndarray, drawn: np.ndarray, depth: int, rate: float, penalty: float) -> np.ndarray:
    """Boosted trees for several training sets at once. train: (set, row); rows: each set's row to predict; drawn: (set,
    round, row), the rows that a round may use. Squared loss: gradients are residuals and second derivatives 1, so a leaf is
    the residuals' sum over (their number + penalty)."""
    base = (train * y).sum(1) / train.sum(1)
    fitted = np.repeat(base[:, None], len(y), 1)
    for some in np.moveaxis(drawn & train[:, None, :], 1, 0).astype(float):
        residual = y - fitted
        label = grow(x, some, residual, depth, penalty)
        value = np.zeros_like(fitted)
        for leaf in np.unique(label):
            here = (label == leaf) * some
            value += (label == leaf) * ((here * residual).sum(1) / (here.sum(1) + penalty))[:, None]
        fitted = fitted + rate * value
    return fitted[np.arange(len(rows)), rows]
