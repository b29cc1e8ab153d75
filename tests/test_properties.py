"""Properties that the operators must have, on small made inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemetry.functions.numeric import band, present, quality_bucket
from tandemetry.functions.signal import biquads, lowpass, spectral_arc_length
from tandemetry.operators import agreement as A
from tandemetry.operators import calibration as C
from tandemetry.operators import gates, models
from tandemetry.operators import geometry as G
from tandemetry.operators import ranking as R
from tandemetry.operators import relational, resampling
from tandemetry.operators import timeseries as T
from tandemetry.plans import timeseries_queries as Q


def pairs(spark, x, y, **keys):
    return spark.createDataFrame([(float(a), float(b), *keys.values()) for a, b in zip(x, y)], ["x", "y", *keys])


def test_limits_of_agreement_centre_on_the_bias(spark):
    r = A.agreement(pairs(spark, [1, 2, 4], [1.5, 1.8, 5], k=1), ["k"]).first()
    assert abs((r.loa_lower + r.loa_upper) / 2 - r.bias) < 1e-12


def test_consistency_ignores_a_constant_bias(spark):
    r = A.agreement(pairs(spark, range(1, 13), range(6, 18), k=1), ["k"]).first()
    assert r.icc_c1 > 0.999 and r.icc_c1 > r.icc_a1


def test_closed_forms_equal_the_analysis_of_variance(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=20)
    y = x + rng.normal(size=20) + 0.3
    r = A.agreement(pairs(spark, x, y, k=1), ["k"]).first()
    m = np.stack([x, y], 1)
    n, g = 20, m.mean()
    msr = 2 * ((m.mean(1) - g) ** 2).sum() / (n - 1)
    msc = n * ((m.mean(0) - g) ** 2).sum()
    mse = ((m - m.mean(1, keepdims=True) - m.mean(0) + g) ** 2).sum() / (n - 1)
    assert r.icc_a1 == pytest.approx((msr - mse) / (msr + mse + 2 * (msc - mse) / n), abs=1e-12)
    assert r.icc_c1 == pytest.approx((msr - mse) / (msr + mse), abs=1e-12)
    slope = np.polyfit((x + y) / 2, y - x, 1)
    assert (r.prop_slope, r.prop_intercept) == pytest.approx(tuple(slope), abs=1e-10)


def test_too_small_or_flat_groups_are_null(spark):
    one = A.agreement(pairs(spark, [1], [2], k=1), ["k"]).first()
    assert one.n == 1 and one.icc_a1 is None and one.pearson is None
    flat = A.agreement(pairs(spark, [1, 1, 1], [1, 1, 1], k=1), ["k"]).first()
    assert flat.icc_a1 is None and flat.prop_slope is None
    assert A.agreement(pairs(spark, [1, float("nan"), 2], [1, 3, float("inf")], k=1), ["k"]).first().n == 1


def test_student_p_of_the_slope():
    # two-sided p of t = 2.2281 with ten degrees is 0.05
    t, df = 2.2281388519649385, 10
    assert A.beta_regularised(df / (df + t * t), df / 2, 0.5) == pytest.approx(0.05, abs=1e-9)


def test_bands_are_right_closed_and_missing_counts_as_good(spark):
    v = spark.createDataFrame([(6.81,), (6.82,), (8.285,), (9.0,), (None,)], "v double")
    assert [r[0] for r in v.select(band("v", (6.81, 8.285))).collect()] == [0, 1, 1, 2, None]
    assert v.select(quality_bucket("v")).collect()[-1][0] == "good"
    assert spark.range(1).select(present(F.lit(float("nan")))).first()[0] is None


def test_bootstrap_by_sums_equals_copies_of_rows(spark):
    rng = np.random.default_rng(3)
    who = np.repeat(np.arange(6), 4)
    x = rng.normal(size=24)
    y = x + rng.normal(size=24)
    df = spark.createDataFrame([(float(a), float(b), int(c), "f") for a, b, c in zip(x, y, who)], "x double, y double, participant int, feature string")
    w = resampling.numpy_weights(spark, list(range(6)), "participant", 5, 7)
    got = {r.rep: r for r in resampling.replicated(resampling.cluster_sums(df, ["feature"], "participant"), w, ["feature"], "participant").collect()}
    for rep, d in enumerate(np.random.default_rng(7).integers(0, 6, (5, 6))):
        i = np.concatenate([np.flatnonzero(who == c) for c in d])
        a, b = x[i], y[i]
        c = np.cov(a, b)
        assert got[rep].n == len(i) and got[rep].bias == pytest.approx((b - a).mean(), abs=1e-12)
        assert got[rep].icc_c1 == pytest.approx(2 * c[0, 1] / (c[0, 0] + c[1, 1]), abs=1e-12)


def series(spark, t, v):
    return spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, v))], "k int, frame int, t double, v double")


def test_uniform_grid_is_exact(spark):
    t = np.array([10, 10.031, 10.069, 10.101, 10.137]) - 10
    out = T.uniform_resample(series(spark, t, np.zeros(5)), "k", 30.0).orderBy("i").collect()
    assert np.allclose(np.diff([r.t for r in out]), 1 / 30, atol=1e-12)


def test_interpolation_hits_the_middle_and_clamps(spark):
    grid = spark.createDataFrame([(1, i, t) for i, t in enumerate([-1.0, 0.0, 0.5, 1.0, 9.0])], "k int, i long, t double")
    out = T.interpolate(series(spark, [0, 1], [0, 1]), grid, "k").orderBy("i").collect()
    assert [r.v for r in out] == [0, 0, 0.5, 1, 1]


def test_gradient_matches_numpy(spark):
    rng = np.random.default_rng(0)
    t, v = np.cumsum(rng.uniform(0.1, 1, 9)), rng.normal(size=9)
    out = series(spark, t, v).select("frame", T.gradient(["k"], "frame", "t", "v").alias("g")).orderBy("frame").collect()
    assert np.allclose([r.g for r in out], np.gradient(v, t, edge_order=1), atol=1e-10)


def test_gaps(spark):
    df = spark.createDataFrame([(k, i, v) for k, vs in {1: [None, 1.0, None, 3.0, None], 2: [None, None]}.items() for i, v in enumerate(vs)], "k int, frame int, v double")
    out = df.select("k", "frame", T.fill_gaps(["k"], "frame", "v").alias("f")).orderBy("k", "frame").collect()
    assert [r.f for r in out] == [1, 1, 2, 3, 3, 0, 0]


def test_delayed_signal_has_a_negative_lag(spark):
    t = np.arange(0, 4, 1 / 60)
    pulse = lambda c: np.exp(-((t - c) ** 2) / 0.02) + 0.5 * np.exp(-((t - c - 1) ** 2) / 0.03)
    two = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(pulse(1.2), pulse(1.4)))], "k int, i long, q double, k2 double").withColumnRenamed("k2", "kk")
    two = two.select(F.col("k").alias("key"), "i", "q", F.col("kk").alias("k"))
    best = T.best_lags(T.overlap_correlations(two, "key", range(-30, 31)), "key", (30,)).first()
    assert best.lag == -12 and best.r > 0.99 and not best.on_edge


def test_lags_that_only_rounding_tells_apart_are_ties(spark):
    """Straight lines correlate by 1 at every lag, whatever their offset and slope; a bend that is small, but not noise, does count."""
    rng = np.random.default_rng(3)
    rows = [(20 * n + m, i, a + u * i, b + v * i) for n in (8, 9, 11, 14, 40) for m in range(20) for a, b, u, v in [(*rng.normal(0, 100, 2).tolist(), *rng.uniform(0.1, 9, 2).tolist())] for i in range(n)]
    best = T.best_lags(T.overlap_correlations(spark.createDataFrame(rows, "key int, i long, q double, k double"), "key", range(-6, 7)), "key", (3, 6)).collect()
    assert len(best) == 200 and all(b.lag == -min(b.window, b.key // 20 - 8) and abs(b.r - 1) < 1e-12 and b.on_edge == (abs(b.lag) == b.window) for b in best)
    bent = spark.createDataFrame([(1, i, float(i), i + 1e-4 * (i == 19)) for i in range(20)], "key int, i long, q double, k double")
    best = T.best_lags(T.overlap_correlations(bent, "key", range(-6, 7)), "key", (6,)).first()
    assert best.lag == 1 and best.r < 1 + 1e-12


def test_lag_queries_take_the_most_negative_of_tied_lags(spark, tmp_path):
    """Two clicks and two views a user, on eleven points of the grid: eight are left at a lag of three."""
    rng = np.random.default_rng(4)
    ends = lambda: ((rng.uniform(0, 2000), v := rng.uniform(0, 99)), (434000 + rng.uniform(0, 20000), v + rng.uniform(1, 99)))
    rows = [(user, kind, t, round(v, 2)) for user in range(40) for kind in ("click", "view") for t, v in ends()]
    ev = spark.createDataFrame(rows, "user_id long, event_type string, t double, value double").withColumn("ts", F.expr("timestamp_micros(1704067200000000 + cast(t * 1e6 as long))").cast("timestamp_ntz"))
    ev.select(F.monotonically_increasing_id().alias("event_id"), "ts", "user_id", "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    best = Q.overlap_lag(spark, str(tmp_path)).collect()
    assert len(best) == 80 and all((b.lag, b.r, b.on_edge) == (-3, 1.0, b.window == 3) for b in best)
    assert sorted((b.user_id, b.lag, b.n) for b in Q.lag_corrected(spark, str(tmp_path)).collect()) == [(user, -3, 8) for user in range(40)]


def test_filter_gain():
    def gain(f):
        z = np.exp(-2j * np.pi * f / 30)
        h = 1
        for b0, b1, b2, a1, a2 in biquads(6, 30):
            h *= (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
        return abs(h) ** 2

    assert gain(0) == pytest.approx(1) and gain(6) == pytest.approx(0.5) and gain(15) == pytest.approx(0, abs=1e-12)


def test_filter_keeps_constants_lines_and_short_signals(spark):
    for v, close in (([3.0] * 30, 1e-9), ([0.5 * i for i in range(40)], 1e-3)):
        out = spark.createDataFrame([(v,)], "v array<double>").select(lowpass(F.col("v"), 6.0, 30.0)).first()[0]
        assert np.allclose(out, v, atol=close)
    assert spark.createDataFrame([([1.0, 5.0],)], "v array<double>").select(lowpass(F.col("v"), 6.0, 30.0)).first()[0] == [1.0, 5.0]


def test_smoothness_is_finite_and_null_without_signal(spark):
    v = [1 + 0.001 * math.sin(2 * math.pi * i / 30) for i in range(120)]
    df = spark.createDataFrame([(v,), ([0.0] * 9,), ([1.0],)], "v array<double>")
    a, b, c = (r[0] for r in df.select(spectral_arc_length(F.col("v"), 30.0)).collect())
    assert math.isfinite(a) and b is None and c is None


def test_dispersion_of_a_still_and_a_moved_body(spark):
    rng = np.random.default_rng(2)
    still = rng.normal(size=(17, 3))
    for move in (0.0, 0.2):
        shift = np.linspace(0, move, 30)
        rows = [(1, i, i / 30, j, float(still[j, 0] + shift[i]), float(still[j, 1]), float(still[j, 2])) for i in range(30) for j in range(17)]
        f = G.frames(spark.createDataFrame(rows, "label int, frame int, t double, joint int, x double, y double, z double"))
        got = G.pelvis_features(G.in_body_frame(f)).first().dispersion
        assert got == pytest.approx(shift.std(), abs=1e-7)


def test_ridge_calibration_recovers_a_line(spark):
    y = np.linspace(-2, 2, 100)
    df = spark.createDataFrame([("f", i % 4, i, float(3 + 2 * v), float(v)) for i, v in enumerate(y)], "feature string, participant int, gesture int, x double, y double")
    s = C.participant_sums(df)
    c = C.coefficients(s, s.select("feature", F.col("participant").alias("held"), F.lit(0.01).alias("alpha")))
    for r in c.collect():
        assert (r.slope, r.intercept) == pytest.approx((2, 3), abs=1e-3)
    assert {r.alpha for r in C.chosen_alphas(s).collect()} == {0.01}


def test_dual_weights_equal_standardised_ridge():
    rng = np.random.default_rng(5)
    x, y, q = rng.normal(size=(9, 15)), rng.normal(size=9), rng.normal(size=15)
    for alpha in (0.1, 1.0, 10.0, 100.0):
        z = (x - x.mean(0)) / x.std(0)
        w = np.linalg.solve(z.T @ z + alpha * np.eye(15), z.T @ (y - y.mean()))
        assert R.dual_weights(x, q, alpha) @ y == pytest.approx((q - x.mean(0)) / x.std(0) @ w + y.mean(), abs=1e-10)


def test_nested_predictions_equal_a_plain_loop(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(7, 5)), rng.normal(size=7)
    m = spark.createDataFrame([(i, x[i].tolist()) for i in range(7)], "participant int, x array<double>")
    labels = spark.createDataFrame([(i, float(y[i])) for i in range(7)], "participant int, label double")
    got = {r.participant: (r.prediction, r.alpha) for r in R.nested_predictions(R.response_weights(m), labels, []).collect()}
    for o in range(7):
        rest = [i for i in range(7) if i != o]
        loss = [np.mean([abs(R.dual_weights(x[[j for j in rest if j != i]], x[i], a) @ y[[j for j in rest if j != i]] - y[i]) for i in rest]) for a in R.ALPHAS]
        a = R.ALPHAS[int(np.argmin(loss))]
        assert got[o] == (pytest.approx(R.dual_weights(x[rest], x[o], a) @ y[rest], abs=1e-9), a)


def test_holm(spark):
    p = spark.createDataFrame([("a", 1165 / 10001), ("b", 290 / 10001)], "name string, p double")
    got = {r.name: r.p_holm for r in R.holm(p, "name", "p").collect()}
    assert got["b"] == pytest.approx(0.05799420057994201) and got["a"] == pytest.approx(0.11648835116488351)


def test_rank_metrics_of_a_perfect_and_a_reversed_order(spark):
    rows = [(s, i, float(i), float(i if s == "up" else 9 - i)) for s in ("up", "down") for i in range(10)]
    got = {r.s: r for r in R.rank_metrics(spark.createDataFrame(rows, "s string, participant int, truth double, prediction double"), ["s"], (3.0, 6.0)).collect()}
    assert (got["up"].spearman, got["up"].kendall, got["up"].kappa) == pytest.approx((1, 1, 1))
    assert (got["down"].spearman, got["down"].kendall) == pytest.approx((-1, -1))


def test_exclusion_by_rank_and_keys(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 9, 9, 1])], "id int, v double")
    assert sorted(r.id for r in relational.exclude_top(df, "id", "v", 0.3).collect()) == [0, 3]
    assert sorted(r.id for r in relational.exclude_top(df, "id", "v", 0.25).collect()) == [0, 2, 3]
    k = spark.createDataFrame([("P01T02",), ("P01",)], "k string").select(relational.key_parts(F.col("k"), r"(P\d{2})(T\d{2})", ["p", "t"]).alias("s")).collect()
    assert k[0].s.p == "P01" and k[1].s.p is None
    assert relational.aligned(df, df.filter("id > 1"), ["id"]) == 2


def test_gates_stop(spark):
    df = spark.range(3)
    gates.enforce(gates.checks(df, {"three": F.count(F.lit(1)) == 3}))
    with pytest.raises(AssertionError, match="four"):
        gates.enforce(gates.checks(df, {"four": F.count(F.lit(1)) == 4}))


def test_gates_observed_while_writing(spark):
    df = spark.range(100).repartition(3)
    low = {"hundred": F.count(F.lit(1)) == 100, "low": F.bool_and(F.col("id") < 100)}
    assert gates.guarded(df, "ids", low).count() == 100
    with pytest.raises(AssertionError, match="few, low"):
        gates.guarded(df, "ids", {**low, "low": F.bool_and(F.col("id") < 50), "few": F.count(F.lit(1)) < 9})
    with pytest.raises(AssertionError, match="low"):
        gates.guarded(df.limit(0), "ids", {"low": low["low"]})  # nothing holds of no rows


def test_training_range_audit(spark):
    df = spark.createDataFrame([("m", p, 4.97, 9.57) for p in (4.97, 6.1, 9.57, 9.58)], "model string, prediction double, train_low double, train_high double")
    assert models.range_violations(df).first().violations == 1


def test_ordinal_logit_orders_classes():
    x = np.linspace(-3, 3, 60)[:, None]
    k = np.digitize(x[:, 0], [-1, 1])
    w, cut = models.ordinal_fit(x, k, 3)
    assert w[0] > 1 and cut[0] < 0 < cut[1]


def test_jackknife_leaves_a_participant_out_everywhere(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(5, 3)), rng.normal(size=5)
    m = spark.createDataFrame([(i, x[i].tolist()) for i in range(5)], "participant int, x array<double>")
    labels = spark.createDataFrame([(i, float(y[i])) for i in range(5)], "participant int, label double")
    got = R.nested_predictions(R.response_weights(m, omit=True), labels, []).filter("omitted = 2").collect()
    few = R.nested_predictions(R.response_weights(m.filter("participant <> 2")), labels, []).collect()
    assert {(r.participant, round(r.prediction, 9)) for r in got} == {(r.participant, round(r.prediction, 9)) for r in few} and len(got) == 4


def test_tied_ranks(spark):
    df = spark.createDataFrame([(1, v) for v in (3.0, 1.0, 3.0, 2.0)], "k int, v double")
    assert sorted((r.v, r.rank_v) for r in relational.ranked(df, ["k"], ["v"]).collect()) == [(1, 1), (2, 2), (3, 3.5), (3, 3.5)]
