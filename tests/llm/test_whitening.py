"""Whitening against NumPy's eigenvectors and Python's integers; hard spectra; awkward, clashing and empty tables."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tandemetry.llm import whitening as W
from tandemetry.llm.queries import op12_embedding_whitening

from .helpers import clashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """(ids, n, deviations, eigenvalues, eigenvectors, whitened) of rows (id, vector)."""
    x = {i: [math.floor(64 * float(c)) + 1000000 for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviations = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for i, v in x.items()}
    centred = np.array([[float(a - s // n) - (s % n) / n for a, s in zip(v, sums)] for v in fit])
    e, q = np.linalg.eigh(centred.T @ centred / n)
    white = {i: (np.array([a - s // n for a, s in zip(v, sums)]) - [(s % n) / n for s in sums]) @ q[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300)) for i, v in x.items()}
    return n, deviations, e[::-1], white


def check(got, rows, components=16):
    n, deviations, e, white = plain(rows)
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c + 1) for i, _ in rows for c in range(components))
    signs = defaultdict(float)
    for r in got:
        signs[r.component] += r.whitened * white[r.vec_id][r.component - 1]
    for r in got:
        assert (r.n, r.deviation) == (n, deviations[r.vec_id])
        assert r.whitened == pytest.approx(math.copysign(1, signs[r.component]) * white[r.vec_id][r.component - 1], abs=1e-6)
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
        assert r.identity_error < 1e-9


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(op12_embedding_whitening(spark, sf).collect(), rows)


AWKWARD = [(1, [0.5, 1.0, -2.0], 1), (2, [0.25, 0.0, 3.0], 1), (2, [0.25, 0.0, 3.0], 1), (3, None, 1), (4, [1.0, None, 2.0], 1), (5, [1.0, float("nan"), 2.0], 1)]
AWKWARD += [(6, [1.0, float("inf"), 2.0], 1), (7, [], 1), (8, [1.0, 2.0], 1), (9, [9.5, 1.0, 0.0], None), (10, [1e30, 0.0, 0.0], 1), (11, [-3.0, 4.0, 1.25], 1)]


@pytest.mark.parametrize("change", [lambda df: df, clashing])
def test_awkward_rows(spark, change):
    got = W.whiten(change(spark.createDataFrame(AWKWARD, SCHEMA))).collect()
    kept = [(i, v) for i, v, _ in AWKWARD if i in (1, 2, 9, 11)]
    check(got, kept, 3)
    null_id = W.whiten(spark.createDataFrame([*AWKWARD, (None, [1.0, 1.0, 1.0], 1)], SCHEMA)).filter("vec_id is null")
    assert null_id.count() == 3


def test_tables_without_components(spark):
    for rows in ([], [(1, [1.0, 2.0], 1)], [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], [(1, None, 1)]):
        df = W.whiten(spark.createDataFrame(rows, SCHEMA))
        assert df.collect() == [] and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_directions_than_dimensions(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0], 1) for i in range(20)]
    assert {r.component for r in W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()} == {1}


def hard_spectra():
    rng = np.random.default_rng(5)
    for values in ([1.0] * 12, [5.0] * 6 + [1.0] * 6, list(10.0 ** -np.arange(12)), [3.0, 3.0 + 1e-12, 3.0 + 1e-9, 1.0, 1e-8, 0.0, 0.0, 2.0], list(rng.exponential(size=40)), [0.0, 0.0], [4.0]):
        q, _ = np.linalg.qr(rng.normal(size=(len(values),) * 2))
        yield q @ np.diag(values) @ q.T
    yield np.diag([3.0, 1.0, 2.0, 2.0])
    yield np.array([[1.0, 1.0], [1.0, 1.0]])


@pytest.mark.parametrize("a", list(hard_spectra()))
def test_divide_and_conquer(a):
    a = (a + a.T) / 2
    values, vectors = W.spectral(a)
    size = max(np.linalg.norm(a, 2), 1e-300)
    assert values == pytest.approx(np.linalg.eigvalsh(a)[::-1], abs=1e-14 * len(a) * size)
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-14 * len(a) * size


def test_shifts_part_distinct_eigenvalues(monkeypatch):
    monkeypatch.setattr(W, "_rotated", None)  # only for clusters that no shift parts
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.normal(size=(64, 64)))
    W.spectral(q @ np.diag(rng.exponential(size=64)) @ q.T)


def test_polar_factor():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    u = W.polar(a)
    assert np.abs(u @ u - np.eye(30)).max() < 1e-13
    assert np.linalg.eigvalsh(u @ a).min() > -1e-10


def test_exact_products():
    big = np.array([[2**40, -3], [2**41 + 1, 5]])
    want = [[2**80 + (2**41 + 1) ** 2, -3 * 2**40 + 5 * (2**41 + 1)], [-3 * 2**40 + 5 * (2**41 + 1), 34]]
    assert W._exact(big, big).tolist() == want
    far = W.Fit(3, [0, 0], np.eye(2), np.ones(2), np.ones(2))
    assert far.deviations(np.array([[2**61, 1], [2, 3]])) == [None, 9 * 13]
