"""Work on long trajectories and on many short ones: in proportion to the samples, whatever the batches."""

import time

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tandemetry.functions.recurrence import Cascade
from tandemetry.functions.signal import arc_length, biquads, spectral_arc_length
from tandemetry.operators import conditions as C
from tandemetry.operators.batches import changes, whole
from tandemetry.operators.timeseries import interpolate


def test_interpolation_of_a_long_key_is_linear(spark):
    n = 60_000
    knots = spark.range(n, numPartitions=2).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"), (F.col("id") * 2.0).alias("v"))
    grid = spark.range(n - 1, numPartitions=2).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") + 0.25).alias("t"))
    start = time.monotonic()
    found = interpolate(knots, grid, "k").agg(F.count("v").alias("n"), F.max(F.abs(F.col("v") - 2 * F.col("t"))).alias("off")).first()
    assert found.n == n - 1 and found.off < 1e-9
    assert time.monotonic() - start < 20  # 7 * 10^9 steps where each row goes through all that follow


def test_arc_length_is_the_expression(spark):
    rng = np.random.default_rng(1)
    signals = [[float("nan"), *np.abs(rng.normal(size=n))] for n in (3, 4, 50, 121)] + [[1.0, -1.0] * 9, [0.0] * 6]
    df = spark.createDataFrame([(i, [float(x) for x in s]) for i, s in enumerate(signals)], "i int, v array<double>")
    want = {r.i: r.s for r in df.select("i", spectral_arc_length(F.col("v"), 30.0).alias("s")).collect()}
    for i, s in enumerate(signals):
        got = arc_length(np.array(s), 30.0)
        assert (got is None) == (want[i] is None) and (got is None or abs(got - want[i]) < 1e-9), i


def test_cascade_of_any_length():
    c, rng = Cascade(biquads(6.0, 30.0)), np.random.default_rng(2)
    for n in (1, 63, 64, 65, 150):
        x, state = rng.normal(size=(n, 3)), rng.normal(size=(4, 3))
        for got, want in zip(c.run(x, state), c._run(x, state)):
            assert np.abs(got - want).max() < 1e-10


def test_groups_over_batches():
    """Keys that end in a batch, go on over several, are null, or lie at a batch's edge."""
    sizes = [(None, 0, 3), ("a", 0, 25), ("a", 1, 4), ("b", 1, 6), ("c", 1, 2)]
    rows = [(k, j, float(i)) for k, j, n in sizes for i in range(n)]
    rows_ = pa.RecordBatch.from_pylist([{"k": k, "joint": j, "frame": f} for k, j, f in rows])
    for width in (1, 3, 6, 7, 10, 100):
        parts = list(whole(iter([rows_.slice(a, width) for a in range(0, len(rows), width)])))
        ends = [np.concatenate([[0], changes(p), [p.num_rows]]) for p in parts]
        assert [int(x) for e in ends for x in np.diff(e)] == [n for _, _, n in sizes]


def test_many_short_trajectories(spark):
    """No group, so no table, for each trajectory and joint."""
    rng = np.random.default_rng(3)
    many = pd.DataFrame([(s, j, f, f / 30, *rng.normal(size=3)) for s in range(400) for j in range(5) for f in range(6)], columns=["label", "joint", "frame", "t", "x", "y", "z"])
    out = C.preprocessed(spark.createDataFrame(many).coalesce(1), conditions={"as_it_is": C.as_it_is})
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    got = out.toPandas().sort_values(["label", "joint", "frame"]).reset_index(drop=True)
    assert np.allclose(got[["t", "x", "y", "z"]], many[["t", "x", "y", "z"]]) and (got["frame"] == many["frame"]).all()
