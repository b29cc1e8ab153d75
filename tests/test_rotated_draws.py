"""Draws by one order turned, against the rows sorted anew for each replicate; no plan copies rows by replicate."""

import numpy as np
from pyspark.sql import functions as F

from tandemetry.operators import rotated_draws as D
from tandemetry.plans import audit_queries, model_queries

SF = "/root/testdata/sf0.001"


def test_taken_is_the_first_rows_of_each_replicate():
    rng = np.random.default_rng(4)
    for n, known, odd in ((1, 1, False), (9, 9, False), (40, 33, False), (40, 40, True), (5, 0, False)):
        base = np.concatenate([np.sort(rng.integers(0, 50, known)), np.full(n - known, 101)])
        value = rng.normal(size=n)
        value[n // 2] = np.inf if odd else np.nan
        for k in (0, 1, n // 2, n):
            got = D.taken(base, value, k, 12, 37, 101)
            for r in range(12):
                turned = np.where(base < 101, (base + r * 37) % 101, 101)
                some = value[np.argsort(turned, kind="stable")[:k]]
                assert got[0][r] == (~np.isnan(some)).sum() and np.allclose(got[1][r], np.nansum(some))


def test_cells_with_ties_and_missing_values(spark):
    rng = np.random.default_rng(5)
    rows = [(int(c), int(b) if b < 6 else None, float(v), None if v > 7 else float(w)) for c, b, v, w in zip(rng.integers(0, 3, 200), rng.integers(0, 7, 200), rng.integers(0, 9, 200), rng.normal(size=200))]
    df = spark.createDataFrame(rows, "c int, base int, v double, w double")
    ks = {0: 1, 1: 30, 2: 1000}
    ks = {c: min(k, sum(r[0] == c for r in rows)) for c, k in ks.items()}
    got = {(r.rep, r.feature): (r.n, r["mean"]) for r in D.cell_means(df, spark.createDataFrame(list(ks.items()), "c int, k long"), ["c"], ["v", "w"], ["v", "w"], 9, 5, 6).collect()}
    last = lambda x: (x is None, x or 0.0)
    for rep in range(9):
        some = [r for c in ks for r in sorted((r for r in rows if r[0] == c), key=lambda r: (6 if r[1] is None else (r[1] + rep * 5) % 6, last(r[2]), last(r[3])))[: ks[c]]]
        for i, f in ((2, "v"), (3, "w")):
            there = [r[i] for r in some if r[i] is not None]
            assert got[rep, f][0] == len(some) and abs(got[rep, f][1] - sum(there) / len(there)) < 1e-9


def test_no_row_is_copied_by_replicate(spark):
    for query in (audit_queries.distribution_summary, model_queries.random_split, model_queries.equalize_sample):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Generate explode(sequence" not in plan and "explode([0,1,2,3" not in plan
