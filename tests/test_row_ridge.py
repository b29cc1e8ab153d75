"""The ridge over rows, splits, equalised cells and permutations against plain loops over the rows themselves."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemetry.operators import ranking as R
from tandemetry.operators import row_ridge as X
from tandemetry.operators import subsampling
from tandemetry.plans import model_queries, ridge_queries

SF = "/root/testdata/sf0.001"
NAMES = ["c0", "c1", "c2"]


def made(spark, people=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(p, *map(float, rng.normal(p / 3, 1, 3))) for p in range(people) for _ in range(3 + p)]
    labels = {p: float(rng.normal(p, 0.5)) for p in range(people)}
    return spark.createDataFrame(rows, "participant int, c0 double, c1 double, c2 double"), rows, labels


def label_rows(spark, labels):
    return spark.createDataFrame(list(labels.items()), "participant int, label double")


def fitted(x, y, alpha):
    """The prediction of a standardised ridge as a function."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd == 0, 1, sd)
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda q: (q - mean) / sd @ w + y.mean()


def chosen(x, who, labels):
    """By mean absolute error of participants' mean predictions."""
    y = np.array([labels[p] for p in who])
    losses = []
    for a in R.ALPHAS:
        errors = [abs(fitted(x[who != p], y[who != p], a)(x[who == p]).mean() - labels[p]) for p in np.unique(who)]
        losses.append(np.mean(errors))
    return R.ALPHAS[int(np.argmin(losses))]


def test_leave_one_out_over_rows(spark):
    df, rows, labels = made(spark)
    x, who = np.array([r[1:] for r in rows]), np.array([r[0] for r in rows])
    got = {r.participant: r for r in X.leave_one_out(X.moments(df, ["participant"], NAMES), label_rows(spark, labels), []).collect()}
    for p in labels:
        rest = who != p
        a = chosen(x[rest], who[rest], labels)
        want = fitted(x[rest], np.array([labels[i] for i in who[rest]]), a)(x[~rest]).mean()
        assert (got[p].prediction, got[p].alpha, got[p].truth) == (pytest.approx(want, abs=1e-8), a, labels[p])


def test_nulls_flat_columns_and_too_few_participants(spark):
    df, _, labels = made(spark, 2)
    assert X.leave_one_out(X.moments(df, ["participant"], NAMES), label_rows(spark, labels), []).count() == 0
    df, rows, labels = made(spark, 5)
    flat = spark.createDataFrame([(*r[:3], 2.0) for r in rows] + [(0, None, 1.0, 1.0)], df.schema)
    two = X.leave_one_out(X.moments(flat, ["participant"], NAMES), label_rows(spark, labels), []).collect()
    one = {r.participant: r.prediction for r in X.leave_one_out(X.moments(df, ["participant"], NAMES[:2]), label_rows(spark, labels), []).collect()}
    assert len(two) == 5 and all(r.prediction == pytest.approx(one[r.participant], abs=1e-8) for r in two)


def sensors(spark, size=9):
    """Rows of two sensors and four participants with copies among them; indicator columns tell which were drawn."""
    rng = np.random.default_rng(2)
    rows = [(s, p, f"{s}{p}{i}", *map(float, rng.normal(p, 1, 2))) for s in "FO" for p in range(4) for i in range(size + p)]
    copies = [r for r in rows for _ in range(1 + (r[2][-1] == "1") * 3)]
    return spark.createDataFrame(copies, "sensor string, participant int, key string, c0 double, c1 double"), copies


def which(spark, df, reps, **more):
    """(sensor, participant, rep): how often each key was drawn."""
    names = sorted({r.key for r in df.collect()})
    wide = df.select("sensor", "participant", "key", *((F.col("key") == n).cast("double").alias(n) for n in names))
    cells = df.groupBy("sensor", "participant").agg(F.floor(F.count(F.lit(1)) * 0.5).alias("k"))
    out = subsampling.drawn_sums(wide, cells, ["sensor", "participant"], "key", names, reps, 9, products=False, **more).collect()
    return {(r.sensor, r.participant, r.rep): (r.n, tuple(r.s)) for r in out}, names


@pytest.mark.parametrize("chunk", [3, 1000])
def test_draws_are_exact_and_depend_on_rows_alone(spark, chunk):
    df, rows = sensors(spark)
    got, names = which(spark, df, 40, chunk_rows=chunk)
    again, _ = which(spark, df.repartition(7).orderBy(F.rand(4)).repartition(3), 40, chunk_rows=chunk)
    assert got == again and len(got) == 8 * 40
    times = Counter(r[2] for r in rows)
    for (sensor, participant, _), (n, s) in got.items():
        cell = Counter({r[2]: times[r[2]] for r in rows if r[:2] == (sensor, participant)})
        assert n == sum(s) == sum(cell.values()) // 2
        assert all(v <= cell[k] for k, v in zip(names, s))
    for name in names:  # half of a cell's rows is drawn, each as often as any other
        share = [s[names.index(name)] / times[name] for k, (_, s) in got.items() if name.startswith(f"{k[0]}{k[1]}")]
        assert 0.2 < np.mean(share) < 0.8


def test_drawn_moments(spark):
    df, rows = sensors(spark)
    by_name, names = which(spark, df, 3)
    value = {r[2]: np.array(r[3:]) for r in rows}
    cells = df.groupBy("sensor", "participant").agg(F.floor(F.count(F.lit(1)) * 0.5).alias("k"))
    for r in subsampling.drawn_sums(df, cells, ["sensor", "participant"], "key", ["c0", "c1"], 3, 9).collect():
        n, s = by_name[r.sensor, r.participant, r.rep]
        assert r.n == n and r.s == pytest.approx(sum(c * value[k] for k, c in zip(names, s)))
        assert r.q == pytest.approx(sum(c * np.outer(value[k], value[k]) for k, c in zip(names, s)).ravel())


def test_random_split(spark):
    df, rows = sensors(spark)
    labels = {p: float(p) ** 1.5 for p in range(4)}
    train, test = ridge_queries.split(df, 2, ["c0", "c1"])
    names = sorted({r[2] for r in rows})
    wide = df.select("sensor", "participant", "key", *((F.col("key") == n).cast("double").alias(n) for n in names))
    held = {(r.sensor, r.rep, r.participant): dict(zip(names, r.s)) for r in ridge_queries.split(wide, 2, names)[1].collect()}
    got = {(r.sensor, r.rep, r.participant): r for r in X.held_rows(train, test, label_rows(spark, labels), ["sensor", "rep"]).collect()}
    assert set(got) == set(held) and len(got) == 2 * 2 * 4
    value, times = {r[2]: np.array(r[3:]) for r in rows}, Counter(r[2] for r in rows)
    for sensor, rep in {k[:2] for k in held}:
        mine = lambda count: [(p, k) for p in range(4) for k in names if k.startswith(f"{sensor}{p}") for _ in range(int(count(p, k)))]  # noqa: E731, B023
        out, kept = mine(lambda p, k: held[sensor, rep, p][k]), mine(lambda p, k: times[k] - held[sensor, rep, p][k])  # noqa: B023
        for p in range(4):
            size = sum(q == p for q, _ in out) + sum(q == p for q, _ in kept)
            assert sum(q == p for q, _ in out) == max(1, round(0.3 * size))
        x, who = np.array([value[k] for _, k in kept]), np.array([p for p, _ in kept])
        a = chosen(x, who, labels)
        fit = fitted(x, np.array([labels[p] for p in who]), a)
        for p in range(4):
            want = fit(np.array([value[k] for q, k in out if q == p])).mean()
            assert (got[sensor, rep, p].prediction, got[sensor, rep, p].alpha) == (pytest.approx(want, abs=1e-6), a)


def test_queries_agree_however_rows_are_dealt(spark, monkeypatch):
    data = ridge_queries.rows(spark, SF)
    one, two = ridge_queries.equalized(data, 2).collect(), ridge_queries.equalized(data.repartition(11, "key"), 2).collect()
    assert {(r.rep, r.participant): [round(v, 9) for v in r.x] for r in one} == {(r.rep, r.participant): [round(v, 9) for v in r.x] for r in two}


def plain_nested(x, y):
    out = []
    for o in range(len(y)):
        rest = [i for i in range(len(y)) if i != o]
        loss = []
        for a in R.ALPHAS:
            sets = [([j for j in rest if j != i], i) for i in rest]
            loss.append(np.mean([abs(fitted(x[t], y[t], a)(x[i]) - y[i]) for t, i in sets]))
        a = R.ALPHAS[int(np.argmin(loss))]
        out.append((fitted(x[rest], y[rest], a)(x[o]), a))
    return out


@pytest.mark.parametrize("chunk", [2, 1000])
def test_permutations_refit_everything(spark, chunk):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(7, 4)), rng.normal(size=7)
    matrix = spark.createDataFrame([(i, x[i].tolist()) for i in range(7)], "participant int, x array<double>")
    got = defaultdict(dict)
    for r in R.permuted_predictions(matrix, label_rows(spark, dict(enumerate(map(float, y)))), 4, 5, chunk).collect():
        got[r.rep][r.participant] = r
    assert [got[0][i].truth for i in range(7)] == y.tolist() and sorted(got) == [0, 1, 2, 3, 4]
    for rep, people in got.items():
        dealt = np.array([people[i].truth for i in range(7)])
        assert sorted(dealt) == sorted(y)
        for i, (prediction, alpha) in enumerate(plain_nested(x, dealt)):
            assert (people[i].prediction, people[i].alpha) == (pytest.approx(prediction, abs=1e-8), alpha)
    assert len({tuple(people[i].truth for i in range(7)) for people in got.values()}) > 3


def test_p_counts_the_permutations_at_least_as_strong(spark, monkeypatch):
    monkeypatch.setattr(model_queries, "PERMUTATIONS", 60)
    rows = {r.rep: r for r in model_queries.permutation_null(spark, SF).collect()}
    strong = sum(abs(r.rho) >= abs(rows[0].rho) for i, r in rows.items() if i)
    assert len(rows) == 61 and rows[0].p == pytest.approx((1 + strong) / 61, abs=1e-6)


def test_equalised_cells(spark):
    data = ridge_queries.rows(spark, SF)
    count = Counter((r.participant, r.gesture, r.sensor) for r in data.collect())
    by_cell = defaultdict(list)
    for r in data.collect():
        by_cell[r.participant, r.gesture, r.sensor].append([r[n] for n in ridge_queries.FEATURES])
    matrices = ridge_queries.equalized(data, 3)
    for r in matrices.collect():
        for g in range(1, 8):
            f, o = count[r.participant, g, "F"], count[r.participant, g, "O"]
            assert min(f, o) > 0
            if f <= o:  # nothing is left out of such a cell
                assert r.x[(g - 1) * 4 : g * 4] == pytest.approx(np.mean(by_cell[r.participant, g, "F"], 0), abs=1e-9)
    labels = {r.participant: r.label for r in ridge_queries._labels(spark, SF).collect()}
    got = {(r.rep, r.participant): r for r in R.replicate_predictions(matrices, label_rows(spark, labels)).collect()}
    for rep in range(3):
        some = sorted((r for r in matrices.collect() if r.rep == rep and r.participant in labels), key=lambda r: r.participant)
        if len(some) > 3:
            for r, (prediction, alpha) in zip(some, plain_nested(np.array([r.x for r in some]), np.array([labels[r.participant] for r in some]))):
                assert (got[rep, r.participant].prediction, got[rep, r.participant].alpha) == (pytest.approx(prediction, abs=1e-7), alpha)


def test_jackknife_against_a_plain_loop(spark):
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(7, 5)), rng.normal(size=7)
    matrix = spark.createDataFrame([(i, x[i].tolist()) for i in range(7)], "participant int, x array<double>")
    rows = R.nested_predictions(R.response_weights(matrix, omit=True), label_rows(spark, dict(enumerate(map(float, y)))), []).collect()
    got = {(r.omitted, r.participant): r for r in rows}
    assert len(got) == 7 * 6
    for gone in range(7):
        rest = [i for i in range(7) if i != gone]
        for i, (prediction, alpha) in zip(rest, plain_nested(x[rest], y[rest])):
            assert (got[gone, i].prediction, got[gone, i].alpha) == (pytest.approx(prediction, abs=1e-8), alpha)
