"""Ranks, quantiles and tau of one large key over many ranges, against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemetry.operators import order_statistics as S


def made(spark, n=900, seed=1, spread=40):
    rng = np.random.default_rng(seed)
    rows = [(None if i % 3 == 0 else "k" if i % 3 == 1 else "l", float(rng.integers(spread)), float(np.round(rng.normal(), 1))) for i in range(n)]
    rows += [("k", 7.0, 0.5)] * (n // 2) + [("k", None, 1.0), ("k", float("nan"), 1.0), ("lone", 2.0, 3.0), ("none", None, None)]
    return spark.createDataFrame(rows, "g string, x double, y double"), rows


def groups(rows):
    real = [r for r in rows if all(v is not None and v == v for v in r[1:])]
    return {g: [r[1:] for r in real if r[0] == g] for g in {r[0] for r in real}}


def plain_tau(pairs):
    d = [(np.sign(a[0] - b[0]), np.sign(a[1] - b[1])) for a, b in itertools.combinations(pairs, 2)]
    x, y = sum(a != 0 for a, _ in d), sum(b != 0 for _, b in d)
    return sum(a * b for a, b in d) / np.sqrt(x * y) if x and y else None


@pytest.mark.parametrize("block", [8, 100, 1 << 16])
def test_tau(spark, block):
    df, rows = made(spark)
    got = {r.g: r.kendall for r in S.kendall(df, ["g"], "x", "y", block).collect()}
    cells = {r.g: r.kendall for r in S.kendall_cells(df.filter("not isnan(x)"), ["g"], "x", "y").collect()}
    for g, pairs in groups(rows).items():
        assert got[g] == (pytest.approx(plain_tau(pairs), abs=1e-12) if len(pairs) > 1 else None)
        assert cells[g] == got[g] or cells[g] == pytest.approx(got[g], abs=1e-12)
    assert "none" not in got and cells["none"] is None


def test_inversions():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 64, 65, 500):
        q, w = rng.integers(0, 30, n).astype(float), rng.integers(1, 4, n).astype(float)
        assert S.inversions(q, w) == sum(w[i] * w[j] for i in range(n) for j in range(i + 1, n) if q[i] > q[j])


def test_ranks_and_quantiles(spark):
    df, rows = made(spark)
    at = {"least": 0.0, "q25": 0.25, "median": 0.5, "p95": 0.95, "most": 1.0}
    q = {r.g: r for r in S.quantiles(df, ["g"], "x", at).collect()}
    ranks = S.ranked(df, ["g"], ["x", "y"]).collect()
    assert len(ranks) == len(rows)
    for g in {r[0] for r in rows}:
        x = np.array([r[1] for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]])
        assert (g in q) == bool(len(x))
        if len(x):
            assert [q[g][n] for n in at] == pytest.approx(np.quantile(x, list(at.values())))
        for r in ranks:
            if r.g == g:
                missing = r.x is None or r.x != r.x
                assert r.rank_x == (None if missing else (x < r.x).sum() + ((x == r.x).sum() + 1) / 2)


def test_one_key_is_many_ranges(spark):
    df = spark.range(5000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 5003).cast("double").alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few bytes would be one range
    seen = {}
    kept = S.written

    def spy(table, name):
        out = kept(table, name)
        seen.update({r._range: r["count"] for r in out.groupBy("_range").count().collect()})
        return out

    S.written = spy
    try:
        out = S.running(S._counted(df, ["g"], ["x"]), ["g"], ["x"])
    finally:
        S.written = kept
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(seen) > 1 and max(seen.values()) < 5000 * 0.6
    assert sorted((r.x, r.before, r.n) for r in out.collect()) == [(v, i, 5000) for i, v in enumerate(sorted(r.x for r in df.collect()))]
