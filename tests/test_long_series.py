"""Long series in chunks give what one task gives, whatever the chunks' size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemetry.functions.recurrence import BLOCK, Cascade
from tandemetry.functions.signal import biquads
from tandemetry.operators import long_series as L
from tandemetry.operators import timeseries as T
from tandemetry.operators.conditions import zero_phase

SIZES = [7, 64, 100_000]


def made(spark, sizes=(230, 1, 40), gaps=True):
    rng = np.random.default_rng(4)
    rows = []
    for k, n in enumerate(sizes):
        t = np.cumsum(rng.exponential(0.05, n) * (rng.random(n) > 0.2))  # some steps are 0
        for i in range(n):
            hole = gaps and (30 <= i < 75 or rng.random() < 0.3)
            rows.append((k, i, float(t[i]), float(rng.normal()), None if hole else float(rng.normal())))
    rows += [(9, i, float(i), 1.0, None) for i in range(20)]
    return spark.createDataFrame(rows, "k int, frame long, t double, v double, g double")


def same(a, b, *columns):
    sort = lambda df: sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
    x, y = sort(a), sort(b)
    assert len(x) == len(y) > 0
    for p, q in zip(x, y):
        assert all(u == v or u == pytest.approx(v, abs=1e-9) for u, v in zip(p, q))


@pytest.mark.parametrize("size", SIZES)
def test_windows_over_chunks(spark, size):
    df = made(spark)
    kept = T.strictly_increasing(df, "k", "frame", "t")
    same(L.strictly_increasing(df, "k", "frame", "t", size=size), kept, "k", "frame")
    same(L.with_gradient(kept, "k", "frame", "t", "v", "d", size), kept.withColumn("d", T.gradient(["k"], "frame", "t", "v")), "k", "frame", "d")
    same(L.with_filled(df, "k", "frame", "g", "f", size), df.withColumn("f", T.fill_gaps(["k"], "frame", "g")), "k", "frame", "f")


@pytest.mark.parametrize("size", SIZES)
def test_resampling_over_chunks(spark, size):
    df = T.strictly_increasing(made(spark), "k", "frame", "t")
    same(L.uniform_resample(df, "k", 30.0, size=size, order="frame"), T.uniform_resample(df, "k", 30.0), "k", "i", "v")
    grid = spark.createDataFrame([(k, i, i * 0.3 - 1) for k in (0, 1, 2, 5) for i in range(60)], "k int, i long, t double")
    same(L.interpolate(df, grid, "k", size=size), T.interpolate(df, grid, "k"), "k", "i", "v")


@pytest.mark.parametrize("size", [5, 64, 1000])
def test_filter_over_chunks(spark, size):
    df = made(spark, (230, 1, 15, 16, 40), gaps=False).filter("k <> 9").withColumn("u", F.col("v") * F.col("v"))
    got = {(r.k, r.pos): (r.v, r.u) for r in L.lowpass(df.repartition(6), "k", "frame", ["v", "u"], 6.0, 30.0, size).collect()}
    rows = df.orderBy("k", "frame").collect()
    assert len(got) == len(rows)
    for k in {r.k for r in rows}:
        v = np.array([(r.v, r.u) for r in rows if r.k == k])
        for i, want in enumerate(zero_phase(v, 6.0, 30.0)):
            assert got[k, i] == pytest.approx(want, abs=1e-9)


def test_chunks_bound_a_task(spark):
    wide = L.haloed(L.chunked(made(spark), "k", ["frame"], 50), 50, 1, 1)
    assert wide.groupBy("k", "chunk").count().agg(F.max("count")).first()[0] <= 52


@pytest.mark.parametrize("n", [0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK + 5])
def test_blocks_of_a_recurrence(n):
    c = Cascade(biquads(6.0, 30.0))
    rng = np.random.default_rng(n)
    x, state = rng.normal(size=(n, 2)), rng.normal(size=(4, 2))
    y, end = c.run(x, state)
    want, last = c._run(x, state)
    assert y == pytest.approx(want, abs=1e-9) and end == pytest.approx(last, abs=1e-9)
    assert c.over(n) @ state + c.run(x, np.zeros((4, 2)))[1] == pytest.approx(last, abs=1e-9)
