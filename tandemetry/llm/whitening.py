"""Whitening of embeddings by spectral divide and conquer.

Entries become integers (``floor(64 c) + 1000000``), so that sums are exact whatever their order. The fit list, each distinct
vector once, is made by a map-side combined grouping and written; its covariance comes from products of entries less the
rounded mean, added up in each task and then by Spark as decimals, one row per pair of dimensions; what rounding the mean
left is taken off exactly. The matrix is as large as the dimensions squared, whatever the number of rows.

Its components are found by polar decompositions: QDWH iterations (dynamically weighted Halley, in QR form) take a shifted
covariance to its orthogonal factor U, (U + I) / 2 projects onto the eigenvectors above the shift, and the matrix is
restricted to the ranges of this and of the complement, which are split in turn until they are single vectors. The leading
components, at most sixteen, are broadcast and applied to all rows.

Defined results: a vector that is null, empty or holds a null or non-finite entry (or one of 2^56 and more) is left out, and
so is one whose length isn't the table's most frequent (the longer of equally frequent ones); repeated rows stay, a null id
is an id; a component whose eigenvalue is no more than 1e-13 of the largest has no direction and gives no rows, so a table of
one distinct vector gives none; a deviation beyond a long is null. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries of this size or more would overflow a long and count as not finite.
LARGE = 2.0**56
#: Relative size under which an eigenvalue counts as none, and under which what is left off a diagonal does.
FLAT, SMALL = 1e-13, 1e-15
#: Rows of a batch whose results are emitted together.
ROWS = 1024


def polar(a: np.ndarray, most: int = 40) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix, by QDWH iterations in QR form."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = max(1e-17, 0.9 * np.linalg.norm(np.linalg.inv(x), 1) ** -1 / sqrt(n)) if np.linalg.cond(x, 1) < 1e16 else 1e-17
    for _ in range(most):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        e = sqrt(1 + d)
        wa = e + sqrt(max(0.0, 8 - 4 * d + 8 * (2 - l2) / (l2 * e))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / sqrt(wc) * q[:n] @ q[n:].T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (wa + wb * l2) / (1 + wc * l2))
        if moved < 1e-14 * sqrt(n) and 1 - low < 1e-14:
            break
    return x


def _basis(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of what is orthogonal to it, by subspace iteration from its longest columns."""
    start = projector[:, np.argsort(-np.diag(projector), kind="stable")]
    q, _ = np.linalg.qr(start, mode="complete")
    for _ in range(2):  # the leading columns span the range, and the others what is left
        first, _ = np.linalg.qr(projector @ q[:, :rank])
        q, _ = np.linalg.qr(np.hstack([first, q[:, rank:] - projector @ q[:, rank:]]), mode="complete")
    return q[:, :rank], q[:, rank:]


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the eigenvectors above and below a shift among a's eigenvalues; None if no shift parts them."""
    n, size = len(a), np.linalg.norm(a)
    diagonal = np.sort(np.diag(a))
    mid = diagonal[n // 2 - 1 : n // 2 + 1].mean()
    spread = max(np.linalg.norm(a - mid * np.eye(n)), SMALL * size)
    for shift in (mid, diagonal.mean(), *(mid + spread * s for s in (0.03, -0.03, 0.1, -0.1, 0.3, -0.3))):
        u = polar(a - shift * np.eye(n))
        p = (u + np.eye(n)) / 2
        rank = int(round(np.trace(p)))
        if 0 < rank < n and np.linalg.norm(p @ p - p) < 1e-8 * n:
            above, below = _basis(p, rank)
            if np.linalg.norm(above.T @ a @ below) <= 1e-10 * spread + SMALL * n * size:
                return above, below
    return None


def spectral(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a symmetric matrix."""
    todo, done, scale = [np.eye(len(a))], [], np.linalg.norm(a)
    while todo:
        v = todo.pop()
        inner = v.T @ a @ v
        inner = (inner + inner.T) / 2
        off = np.linalg.norm(inner - np.diag(np.diag(inner)))
        halves = _split(inner) if len(inner) > 1 and off > SMALL * scale else None
        if halves is None:
            done.append(_rotated(v, inner) if off > SMALL * scale else v)
        else:
            todo += [v @ h for h in halves]
    vectors = np.hstack(done)
    vectors = _polished(a, vectors)
    values = np.einsum("ij,ik,kj->j", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _rotated(v: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """A cluster that no shift parts, by plane rotations until what is off the diagonal vanishes."""
    inner, v, n = inner.copy(), v.copy(), len(inner)
    for _ in range(30):
        for i in range(n - 1):
            for j in range(i + 1, n):
                if inner[i, j]:
                    angle = 0.5 * np.arctan2(2 * inner[i, j], inner[j, j] - inner[i, i])
                    turn = np.array([[np.cos(angle), np.sin(angle)], [-np.sin(angle), np.cos(angle)]])
                    inner[:, [i, j]] = inner[:, [i, j]] @ turn
                    inner[[i, j]] = turn.T @ inner[[i, j]]
                    v[:, [i, j]] = v[:, [i, j]] @ turn
        if np.linalg.norm(inner - np.diag(np.diag(inner))) <= SMALL * max(np.linalg.norm(inner), 1e-300):
            break
    return v


def _polished(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """What splitting left of rounding, taken off to first order where eigenvalues are apart, then orthonormal again."""
    for _ in range(2):
        inner = v.T @ a @ v
        d = np.diag(inner)
        gap = d[None, :] - d[:, None]
        left = inner - np.diag(d)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(np.abs(gap) > 1e3 * np.abs(left), left / gap, 0.0)
        np.fill_diagonal(step, 0.0)
        v, r = np.linalg.qr(v + v @ step)
        v = v * np.where(np.diag(r) < 0, -1.0, 1.0)
    return v


def integers(rows: DataFrame, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id, x): the vectors of finite entries and of the table's most frequent length, as integers."""
    wide = rows.select(F.col(id_col), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGE))
    clean = wide.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(~bad)
    length = clean.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    entry = lambda c: F.floor(c * SCALE).cast("long") + SHIFT
    return clean.filter(F.size("v") == (length.d if length else -1)).select(id_col, F.transform("v", entry).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch's lists of equal length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), flat.dtype)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product a.T @ b of integers: in floating point while no sum can reach 2^53, else in Python's integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * len(a)
    return (a.astype(float).T @ b.astype(float)).astype(object) if most < 2.0**53 else a.astype(object).T @ b.astype(object)


def _products(fit: DataFrame, centre: list[int]) -> dict[tuple[int, int], int]:
    """The sums of products of the entries less ``centre``: (-1, i) those with one, (-1, -1) the number of vectors."""
    about = np.array(centre, dtype=np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = _matrix(batch.column(0).slice(at, ROWS)) - about
                y = np.hstack([np.ones((len(y), 1), np.int64), y])
                total = _exact(y, y) if total is None else total + _exact(y, y)
        if total is not None:
            i, j = np.triu_indices(len(total))
            sums = pd.array([int(v) for v in total[i, j]], dtype=object)
            yield pa.record_batch([pa.array(i - 1, pa.int32()), pa.array(j - 1, pa.int32()), pa.array([str(v) for v in sums])], names=["i", "j", "s"])

    parts = fit.select("x").mapInArrow(add, "i int, j int, s string")
    sums = parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return {(r.i, r.j): int(r.s) for r in sums.collect()}  # one row per pair of dimensions


@dataclass
class Fit:
    """n vectors with sums per dimension, and for each component its direction, its eigenvalue and share of the trace."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    shares: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def white(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean, taken off as a whole number and a rest, on each component, in units of its deviation."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([float(Fraction(s, self.n) - s // self.n) for s in self.sums])
        return ((x - whole) - rest) @ (self.directions / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sums of (n x - S)^2."""
        sums = np.array(self.sums, dtype=object)
        far = self.n * max(float(np.abs(x - self.mean).max(initial=0.0)), 1.0) + 1
        if far * far * x.shape[1] < 2.0**62 and self.n * float(np.abs(x).max(initial=0)) < 2.0**62:
            d = self.n * x - sums.astype(np.int64)
            return (d * d).sum(1).tolist()
        d = self.n * x.astype(object) - sums
        return [v if v < 2**63 else None for v in (d * d).sum(1)]


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Of the vectors of ``fit``, two passes: sums, then products about the rounded mean. None without any component."""
    width = fit.select(F.size("x")).first()
    if width is None:
        return None
    # sums and number are exact in the first pass, products only needed from the second
    first = fit.agg(F.count(F.lit(1)), *(F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")) for i in range(width[0]))).first()
    n, sums = first[0], [int(s) for s in first[1:]]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    products = _products(fit, centre)
    rest = [s - n * c for s, c in zip(sums, centre)]
    exact = lambda i, j: float(Fraction(n * products[min(i, j), max(i, j)] - rest[i] * rest[j], n * n))
    v = np.array([[exact(i, j) for j in range(len(sums))] for i in range(len(sums))])
    if not np.trace(v) > 0:
        return None
    values, vectors = spectral(v)
    k = min(components, int((values > FLAT * values[0]).sum()))
    vectors = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(0), range(k)])
    return Fit(n, sums, vectors, values[:k], values[:k] / np.trace(v))


def identity_error(fit: DataFrame, model: Fit) -> float:
    """The largest absolute entry of the fit list's whitened covariance less the identity, measured in a pass of its own."""
    held = fit.sparkSession.sparkContext.broadcast(model)
    k = len(model.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w = held.value.white(_matrix(batch.column(0).slice(at, ROWS)))
                w = np.hstack([np.ones((len(w), 1)), w])
                total += w.T @ w
        i, j = np.triu_indices(k + 1)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    sums = np.zeros((k + 1, k + 1))
    for r in fit.select("x").mapInArrow(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        sums[r.i, r.j] = sums[r.j, r.i] = r.s
    mean = sums[0, 1:] / model.n
    return float(np.abs(sums[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row per remaining vector and component."""
    prepare(rows.sparkSession)
    x = integers(rows, vector, id_col)
    fit = materialize(x.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit-list")
    model = fitted(fit, components)
    kind = x.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    held, error, k = rows.sparkSession.sparkContext.broadcast(model), identity_error(fit, model), len(model.values)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                each = np.repeat(np.arange(some.num_rows), k)
                y = _matrix(some.column(1))
                yield pa.record_batch(
                    [
                        some.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(y)), pa.int32()), pa.array(np.full(len(each), m.n)),
                        pa.array(m.deviations(y), pa.int64()).take(pa.array(each)), pa.array(m.white(y).ravel()), pa.array(np.tile(m.shares, len(y))), pa.array(np.full(len(each), error)),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return x.mapInArrow(apply, schema)
