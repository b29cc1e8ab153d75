"""Preprocessing conditions and the composed feature table, against the single operators and plain definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemetry.functions.signal import lowpass, spectral_arc_length
from tandemetry.operators import conditions as C
from tandemetry.plans import catalog, views

SF = "/root/testdata/sf0.001"


def test_the_filter_is_the_expression(spark):
    rng = np.random.default_rng(1)
    for n in (10, 16, 64):
        v = rng.normal(size=n)
        want = spark.createDataFrame([(v.tolist(),)], "v array<double>").select(lowpass(F.col("v"), 6.0, 30.0)).first()[0]
        assert C.zero_phase(v[:, None], 6.0, 30.0)[:, 0] == pytest.approx(want, abs=1e-9)


def test_steps_of_the_conditions():
    t, v = np.array([0.0, 0.03, 0.03, 0.11, 0.2]), np.arange(5.0)[:, None]
    grid, out = C.uniform(t, v, 30.0)
    assert len(grid) == 7 and out[0] == 0 and out[-1] == 4
    assert np.all(np.diff(out[:, 0]) >= 0)
    assert C.fixed_rate(t, v)[0] == pytest.approx(np.arange(5) / 30)
    assert C.filled(np.array([np.nan, 1.0, np.inf, 3.0, np.nan])).tolist() == [1, 1, 2, 3, 3] and C.filled(np.array([np.nan] * 2)).tolist() == [0, 0]
    slow = np.arange(80) / 60
    wave = np.sin(2 * math.pi * 25 * slow)[:, None]
    before, after = C.filter_then_resample(slow, wave)[1], C.resample_then_filter(slow, wave)[1]
    assert np.abs(before[5:-5]).max() < 0.05 < np.abs(after - before).max()  # the order of the steps matters


def test_unchanged_condition_gives_the_single_features(spark):
    table = C.feature_table(views.pose(spark, SF), conditions={"as_it_is": C.as_it_is})
    assert len([c for c in table.columns if c not in ("label", "condition", "missing_rate", "jump_outlier_rate")]) == 16
    got = {r.label: r.asDict() for r in table.collect()}
    for name, more in (("angles_features", {}), ("symmetry_feature", {}), ("velocity_features", {}), ("pelvis_features", {}), ("jump_outliers", {"rate": "jump_outlier_rate"})):
        for r in catalog.queries()[name](spark, SF).collect():
            for c, x in r.asDict().items():
                at = more.get(c, c)
                if at in got[r.label]:
                    assert got[r.label][at] == pytest.approx(x, abs=2e-6), (name, c)
    assert all(r["missing_rate"] == 0 for r in got.values())


def test_missing_coordinates_are_counted_then_filled(spark):
    rows = [(1, j, f, f / 30, float("nan") if f == 3 and j == 0 else float(f), None if f == 5 and j == 1 else 1.0, 2.0 * j) for j in range(2) for f in range(20)]
    pose = spark.createDataFrame(rows, "label int, joint int, frame long, t double, x double, y double, z double")
    q = C.quality(pose).first()
    assert q.missing_rate == pytest.approx(2 / 120) and q.jump_outlier_rate == 0
    out = C.preprocessed(pose, conditions={"as_it_is": C.as_it_is})
    assert out.filter("joint = 0 and frame = 3").first().x == 3 and out.filter("joint = 1 and frame = 5").first().y == 1
    assert C.preprocessed(pose.limit(0)).count() == 0


def test_feature_cache(spark):
    rows = catalog.queries()["feature_cache"](spark, SF).collect()
    labels = views.pose(spark, SF).select("label").distinct().count()
    named = [c for c in rows[0].asDict() if c not in ("label", "condition", "missing_rate", "jump_outlier_rate")]
    for label in {r.label for r in rows}:  # no two conditions agree on uneven times
        assert len({tuple(r[c] for c in named) for r in rows if r.label == label}) == len(C.CONDITIONS)
    assert all(0 < r.missing_rate < 0.05 for r in rows)
    assert len(rows) == labels * len(C.CONDITIONS) and all(r.sparc is not None and math.isfinite(r.peak) for r in rows)


def test_smoothness_of_a_signal_without_positive_samples(spark):
    up = np.abs(np.random.default_rng(2).normal(size=40)).tolist()
    got = spark.createDataFrame([(up,), ([-x for x in up],), ([*up, float("inf")],)], "v array<double>").select(spectral_arc_length(F.col("v"), 30.0)).collect()
    assert got[0][0] == pytest.approx(got[2][0]) and got[1][0] is not None
