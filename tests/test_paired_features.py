"""Features of two instruments: scales, preparations, lags and shifted bounds, against the single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemetry.operators import conditions as C
from tandemetry.operators import geometry as G
from tandemetry.operators import paired_features as P
from tandemetry.plans import views

SF = "/root/testdata/sf0.001"
SCHEMA = "participant string, segment string, sensor string, joint int, frame long, t double, x double, y double, z double"
DELAY, TRUNK = 0.2, {("reference", "a"): 0.5, ("other", "a"): 0.6, ("reference", "b"): 0.5, ("other", "b"): 0.8}


def figure(participant, segment, sensor, times, moved=0.0):
    """A standing figure with a trunk of known length whose parts swing; the pelvis's speed has one clear shape."""
    rng, out = np.random.default_rng(len(segment)), []
    still = rng.normal(size=(len(G.JOINTS), 3)) * 0.3
    still[G.JOINTS.index("pelvis")] = 0
    still[G.JOINTS.index("spine_shoulder")] = (0, 0, TRUNK[sensor, participant])
    for frame, t in enumerate(times):
        s = t - moved
        walk = np.array([math.sin(2.1 * s) + 0.3 * math.sin(5.3 * s + 1), 0.2 * math.sin(3.1 * s), 0.0])
        for j, name in enumerate(G.JOINTS):
            swing = 0 if name in ("pelvis", "spine_shoulder") else 0.05 * math.sin(3 * s + j)
            out.append((participant, segment, sensor, j, frame, float(t), *(float(c) for c in still[j] + walk + swing)))
    return out


@pytest.fixture(scope="module")
def poses(spark):
    even, uneven = np.arange(300) / 100, np.cumsum(np.random.default_rng(3).uniform(0.02, 0.045, 90))
    rows = figure("a", "a1", "reference", even) + figure("a", "a1", "other", uneven, DELAY)
    rows += figure("b", "b22", "reference", even) + figure("b", "b22", "other", uneven)
    rows += figure("a", "alone", "reference", even[:50])  # the other instrument lacks it
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def compared(poses):
    return {(r.segment, r.comparison, r.sensor): r for r in P.paired_features(poses).collect()}


def test_every_comparison_has_both_sensors(compared):
    assert {k[0] for k in compared} == {"a1", "b22"}
    names = {*P.COMPARISONS, "lag_corrected"}
    assert {k for k in compared} == {(s, c, n) for s in ("a1", "b22") for c in names for n in ("reference", "other")}
    assert all(math.isfinite(r[f]) for r in compared.values() for f in P.FEATURES)


def test_scales(compared, poses):
    for s, who in (("a1", "a"), ("b22", "b")):
        for sensor in ("reference", "other"):
            own, none, shared = (compared[s, c, sensor] for c in ("primary", "scale_none", "scale_shared"))
            assert own.scale == pytest.approx(TRUNK[sensor, who], abs=1e-9) and none.scale == 1
            assert shared.scale == pytest.approx(TRUNK["reference", who], abs=1e-9)
            for f in P.FEATURES:
                by = own.scale if f in P.SCALED else 1
                assert none[f] == pytest.approx(own[f] * by) and shared[f] == pytest.approx(none[f] / (shared.scale if f in P.SCALED else 1))
    lost = P.trunk_scales(poses).filter("participant != 'b'")
    who = poses.select("segment", "participant").distinct()
    made = poses.sparkSession.createDataFrame([("b22", n, p, *[1.0] * len(P.FEATURES)) for n, p in (("reference", "matched"), ("other", "timed"))], ["segment", "sensor", "preparation", *P.FEATURES])
    with pytest.raises(Exception, match="no scale of b"):
        P.compared(made, who, lost).collect()
    assert P.compared(made, who, lost, {"scale_none": P.COMPARISONS["scale_none"]}).count() == 2


def test_scaling_the_points_is_scaling_the_features(compared, poses):
    small = poses.filter("segment = 'a1' and sensor = 'other'").select("segment", "joint", "frame", "t", *((F.col(c) / TRUNK["other", "a"]).alias(c) for c in "xyz"))
    want = C.extracted(C.preprocessed(small, "segment", {"timed": C.resample_then_filter}), "segment").first()
    assert all(compared["a1", "primary", "other"][f] == pytest.approx(want[f], abs=1e-7) for f in P.FEATURES)


def test_preparations_differ(compared):
    assert len({compared["a1", c, "reference"].peak for c in ("primary", "rate_only", "native", "cutoff_4", "cutoff_8")}) == 5
    assert len({compared["a1", c, "other"].peak for c in ("primary", "fixed_rate", "cutoff_4", "cutoff_8")}) == 4
    assert compared["a1", "fixed_rate", "other"].duration == pytest.approx(89 / 30)


def test_a_delay_is_found_and_taken_out(compared, poses):
    made = P.prepared(poses.filter("segment != 'alone'"))
    speed = P.pelvis_speed(made)
    found = {(r.segment, r.window): r for r in P.lags(speed).collect()}
    first = float(np.random.default_rng(3).uniform(0.02, 0.045))  # the other's own first time is not 0
    assert found["a1", 60].lag / 60 == pytest.approx(first - DELAY, abs=0.03) and found["b22", 60].lag / 60 == pytest.approx(first, abs=0.03)
    assert all(r.r > 0.9 and not r.on_edge for r in found.values())
    moved = P.lag_corrected(made, P.lags(speed))
    ends = {(r.segment, r.sensor): r.n for r in moved.filter("joint = 0").groupBy("segment", "sensor").agg(F.count("*").alias("n")).collect()}
    assert ends["a1", "reference"] == ends["a1", "other"] < 90
    wide = moved.filter("joint = 0 and segment = 'a1'").groupBy("frame").pivot("sensor", ["reference", "other"]).agg(F.first("x"))
    assert all(abs(r.reference - r.other) < 0.08 for r in wide.collect() if 5 < r.frame < 60)
    assert P.lag_corrected(made, P.lags(speed).withColumn("r", F.lit(0.49))).count() == 0


def test_short_and_absent_segments(spark, poses):
    short = poses.filter("t < 0.2 and segment != 'alone'")
    made = P.prepared(short)
    found = P.lags(P.pelvis_speed(made))
    assert found.count() == 0 and P.lag_corrected(made, found).count() == 0
    assert P.prepared(poses.limit(0)).count() == 0


def test_shifted_bounds(spark):
    recording = views.uneven_pose(spark, SF).filter("label = 3").withColumnRenamed("label", "recording")
    last = recording.agg(F.max("frame")).first()[0]
    bounds = spark.createDataFrame([(3, "s", 0, 11), (3, "e", last - 9, last), (3, "tiny", 4, 9)], "recording int, segment string, start long, stop long")
    got = {(r.segment, r.shift): r for r in P.shifted_features(recording, bounds).collect()}
    assert {k for k in got} == {(s, i) for s in "se" for i in range(-2, 3)}
    cut = lambda n, a, b: recording.filter(F.col("frame").between(a, b)).withColumn("segment", F.lit(n))
    plain = cut("s0", 0, 11).unionByName(cut("s-2", 0, 9)).unionByName(cut("e1", last - 8, last))  # the last two are clamped
    want = {r.segment: r for r in C.extracted(C.preprocessed(plain, "segment", {"timed": C.resample_then_filter}), "segment").collect()}
    for s, shift in (("s", 0), ("s", -2), ("e", 1)):
        assert all(got[s, shift][f] == pytest.approx(want[f"{s}{shift}"][f], abs=1e-9) for f in P.FEATURES)
