"""Queries on trajectories and signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..functions.signal import biquads, lowpass, spectral_arc_length
from ..operators import geometry as G
from ..operators.conditions import feature_table
from ..operators.timeseries import interpolate
from .views import RATE, pose, uneven_pose, wave

CUTOFF = 6.0
#: A joint from one or several markers, in two modes.
MAPPING = [("main", 0, 0), ("main", 1, 1), ("main", 2, 2), ("main", 2, 17), ("main", 3, 3), ("main", 3, 18), ("other", 0, 0), ("other", 0, 19), ("other", 1, 1), ("other", 1, 20), ("other", 2, 2), ("other", 3, 3)]


def joint_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joints as means of markers under both mappings."""
    mapping = spark.createDataFrame(MAPPING, "mode string, joint int, marker int")
    out = G.map_joints(pose(spark, sf_dir).withColumnRenamed("joint", "marker"), mapping, ["label", "frame"])
    return out.select("label", "frame", "mode", "joint", "n", *(r6(c).alias(c) for c in "xyz"))


def _body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.in_body_frame(G.frames(pose(spark, sf_dir)))


def body_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head and wrists relative to the body."""
    b = _body(spark, sf_dir)
    return b.select("label", "frame", *(r6(G.point(F.col("p"), j)[c]).alias(f"{j}_{c}") for j in ("head", "wrist_l", "wrist_r") for c in "xyz"))


def scale_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trunk lengths pooled over frames: median, spread, count."""
    d = G.norm(G.minus(G.point(F.col("p"), "spine_shoulder"), G.point(F.col("p"), "pelvis")))
    f = G.frames(pose(spark, sf_dir)).select("label", d.alias("d")).filter(F.col("d") > 0)
    out = f.groupBy("label").agg(F.percentile("d", F.lit(0.5)).alias("median"), F.stddev_samp("d").alias("sd"), (F.stddev_samp("d") / F.avg("d")).alias("cv"), F.count(F.lit(1)).alias("n"))
    return out.select("label", "n", *(r6(c).alias(c) for c in ("median", "sd", "cv")))


def angles_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.angle_features(_body(spark, sf_dir))
    return out.select("label", *(r6(c).alias(c) for c in out.columns if c not in ("label", "asymmetry")))


def symmetry_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.angle_features(_body(spark, sf_dir)).select("label", r6("asymmetry").alias("asymmetry"))


def pelvis_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and divided by the trunk's length: a scale changes these three only, so it is applied to the result."""
    b = _body(spark, sf_dir)
    out = G.pelvis_features(b).join(b.groupBy("label").agg(F.first("trunk").alias("trunk")), "label")
    return out.select("label", *(r6(c).alias(c) for c in ("dispersion", "path", "duration")), *(r6(F.col(c) / F.col("trunk")).alias(f"{c}_scaled") for c in ("dispersion", "path")))


def velocity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.velocity_features(_body(spark, sf_dir))
    return out.select("label", *(r6(c).alias(c) for c in ("peak", "p95", "rms", "speed")))


def jump_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.jump_outliers(pose(spark, sf_dir), ["label"])
    return out.select("label", "steps", r6("rate").alias("rate"))


def feature_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen features of every trajectory under every preprocessing condition, with the quality of its samples."""
    out = feature_table(uneven_pose(spark, sf_dir))
    return out.select("label", "condition", *(r6(c).alias(c) for c in out.columns if c not in ("label", "condition")))


POINTS = 100


def joint_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels 2k and 2k + 1 as two instruments: both on 100 points of their common time, RMS distance and signed bias per joint."""
    p = pose(spark, sf_dir).withColumn("pair", F.floor(F.col("label") / 2)).withColumn("joint_key", F.concat_ws(":", "label", "joint"))
    ends = p.groupBy("label", "pair").agg(F.max("t").alias("end")).groupBy("pair").agg(F.min("end").alias("end"))
    grid = p.select("joint_key", "pair").distinct().join(ends, "pair").select("joint_key", "end", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(POINTS - 1).cast("long"))).alias("i"))
    grid = grid.select("joint_key", "i", (F.col("end") * F.col("i") / F.lit(POINTS - 1.0)).alias("t"))
    at = interpolate(p.select("joint_key", "t", "x", "y", "z"), grid, "joint_key", "t", ("x", "y", "z"))
    at = at.select(F.substring_index("joint_key", ":", 1).cast("int").alias("label"), F.substring_index("joint_key", ":", -1).cast("int").alias("joint"), "i", "x", "y", "z")
    a, b = (at.filter(F.col("label") % 2 == k).select(F.floor(F.col("label") / 2).alias("pair"), "joint", "i", *(F.col(c).alias(f"{c}{k}") for c in "xyz")) for k in (0, 1))
    d = a.join(b, ["pair", "joint", "i"])
    gap = [F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"]
    return d.groupBy("pair", "joint").agg(r6(F.sqrt(F.avg(sum(g * g for g in gap)))).alias("rmse"), *(r6(F.avg(g)).alias(f"bias_{c}") for c, g in zip("xyz", gap)))


def lowpass_zero_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal filtered; long again for the report."""
    w = wave(spark, sf_dir).select("vec_id", F.posexplode(lowpass(F.col("v"), CUTOFF, RATE)).alias("i", "v"))
    return w.select("vec_id", "i", r6("v").alias("v"))


def sparc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothness of each signal's absolute value."""
    return wave(spark, sf_dir).select("vec_id", r6(spectral_arc_length(F.transform("v", F.abs), RATE)).alias("sparc"))


def _e(j: int, c: str) -> str:
    return f"e[{3 * j + 'xyz'.index(c) + 1}]"


def _at(joint: str, c: str) -> str:
    return _e(G.JOINTS.index(joint), c)


def _angle_sql(name: str, side: str) -> str:
    a, b, c = (G.sided(j, side) for j in G.ANGLES[name])
    u, v = [f"({_at(a, k)} - {_at(b, k)})" for k in "xyz"], [f"({_at(c, k)} - {_at(b, k)})" for k in "xyz"]
    uv, uu, vv = (" + ".join(f"{p} * {q}" for p, q in zip(x, y)) for x, y in ((u, v), (u, u), (v, v)))
    return f"acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({uv}) / greatest(sqrt({uu}) * sqrt({vv}), 1e-12::DOUBLE))))"


_TRUNK = f"sqrt({' + '.join(f'pow({_at('spine_shoulder', c)} - {_at('pelvis', c)}, 2)' for c in 'xyz')})"
FRAMES = "raw AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding::DOUBLE[] AS e FROM embeddings)"
BODY = f"""{FRAMES}, cnt AS (SELECT label, count(*) AS n FROM raw GROUP BY 1),
ref AS (SELECT label, {", ".join(f"median({_at('pelvis', c)}) AS o{c}" for c in "xyz")}, median({_at('hip_l', 'x')} - {_at('hip_r', 'x')}) AS hx, median({_at('hip_l', 'y')} - {_at('hip_r', 'y')}) AS hy,
 median({_at('spine_shoulder', 'z')} - {_at('pelvis', 'z')}) AS up FROM raw JOIN cnt USING (label) WHERE frame < greatest(1, least(n, round_even(n * 0.1::DOUBLE, 0))) GROUP BY label),
trunk AS (SELECT label, median({_TRUNK}) AS trunk FROM raw GROUP BY 1),
lat AS (SELECT *, CASE WHEN sqrt(hx * hx + hy * hy) < 1e-6 THEN 0 ELSE hx / sqrt(hx * hx + hy * hy) END AS lx, CASE WHEN sqrt(hx * hx + hy * hy) < 1e-6 THEN 1 ELSE hy / sqrt(hx * hx + hy * hy) END AS ly, CASE WHEN up < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM ref),
ax AS (SELECT *, ly * s / (sqrt(pow(ly * s, 2) + pow(lx * s, 2)) + 1e-12::DOUBLE) AS fx, -lx * s / (sqrt(pow(ly * s, 2) + pow(lx * s, 2)) + 1e-12::DOUBLE) AS fy FROM lat),
body AS (SELECT label, frame, frame / 30.0::DOUBLE AS t, trunk, flatten(list_transform(range(0, 21), lambda j: [(e[3 * j + 1] - ox) * fx + (e[3 * j + 2] - oy) * fy, s * ((e[3 * j + 2] - oy) * fx - (e[3 * j + 1] - ox) * fy), s * (e[3 * j + 3] - oz)])) AS e
 FROM raw JOIN ax USING (label) JOIN trunk USING (label))"""
_LEAN = {c: f"({_at('spine_shoulder', c)} - {_at('pelvis', c)})" for c in "xyz"}
_SIDE = {s: f"(({_angle_sql('knee', s)} + {_angle_sql('hip', s)}) / 2)" for s in "lr"}
_NAMES = [f"a_{a}_{s}" for a in G.ANGLES for s in "lr"] + [f"e_{e}_{c}" for e in G.ENDPOINTS for c in "xyz"]
_EXPRS = [_angle_sql(a, s) for a in G.ANGLES for s in "lr"] + [_at(e, c) for e in G.ENDPOINTS for c in "xyz"]


def _slope(n: str) -> str:
    """Equal steps of 1/30 s."""
    return f"CASE WHEN lag({n}) OVER w IS NULL THEN (lead({n}) OVER w - {n}) * 30 WHEN lead({n}) OVER w IS NULL THEN ({n} - lag({n}) OVER w) * 30 ELSE (lead({n}) OVER w - lag({n}) OVER w) * 15 END AS {n}"


def _filter_sql() -> str:
    (p0, p1, p2, pa1, pa2), (q0, q1, q2, qa1, qa2) = biquads(CUTOFF, RATE)
    d = lambda x: f"{x!r}::DOUBLE"

    def passed(src: str, out: str) -> str:
        states = lambda x, a, b, c, e: f"{d(p1)} * {x} - {d(pa1)} * ({d(p0)} * {x} + {a}) + {b} AS p1, {d(p2)} * {x} - {d(pa2)} * ({d(p0)} * {x} + {a}) AS p2, {d(q1)} * ({d(p0)} * {x} + {a}) - {d(qa1)} * ({d(q0)} * ({d(p0)} * {x} + {a}) + {c}) + {e} AS q1, {d(q2)} * ({d(p0)} * {x} + {a}) - {d(qa2)} * ({d(q0)} * ({d(p0)} * {x} + {a}) + {c}) AS q2"
        first = f"SELECT vec_id, i, {d(q0)} * ({d(p0)} * x + x * {d(1 - p0)}) + x * {d(1 - q0)} AS y, {states('x', f'x * {d(1 - p0)}', f'x * {d(p2 - pa2)}', f'x * {d(1 - q0)}', f'x * {d(q2 - qa2)}')} FROM {src} WHERE i = 0"
        later = f"SELECT s.vec_id, s.i, {d(q0)} * ({d(p0)} * s.x + f.p1) + f.q1, {states('s.x', 'f.p1', 'f.p2', 'f.q1', 'f.q2')} FROM {out} f JOIN {src} s ON s.vec_id = f.vec_id AND s.i = f.i + 1"
        return f"{out} AS ({first} UNION ALL {later})"

    return f"""WITH RECURSIVE w AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id, list_concat(list_concat(list_transform(range(15, 0, -1), lambda k: 2 * v[1] - v[k + 1]), v), list_transform(range(1, 16), lambda k: 2 * v[len(v)] - v[len(v) - k])) AS v FROM w),
 s1 AS (SELECT vec_id, i - 1 AS i, v[i] AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM x)), {passed('s1', 'f1')},
 s2 AS (SELECT vec_id, max(i) OVER (PARTITION BY vec_id) - i AS i, y AS x FROM f1), {passed('s2', 'f2')}
 SELECT vec_id, (m - i - 15)::INTEGER AS i, round(y, 6) + 0.0 AS v FROM (SELECT *, max(i) OVER (PARTITION BY vec_id) AS m FROM f2) WHERE m - i BETWEEN 15 AND m - 15"""


_R = lambda c, n: f"round({c}, 6) + 0.0 AS {n}"
SQL = {
    "joint_mapping": f"""WITH {FRAMES}, m(mode, joint, marker) AS (VALUES {", ".join(map(str, MAPPING))}), p AS (SELECT label, frame, mode, joint, e[3 * marker + 1] AS x, e[3 * marker + 2] AS y, e[3 * marker + 3] AS z FROM raw, m)
 SELECT label, frame, mode, joint, count(*)::BIGINT AS n, {", ".join(_R(f"avg({c})", c) for c in "xyz")} FROM p GROUP BY ALL""",
    "body_frame": f"WITH {BODY} SELECT label, frame, {', '.join(_R(_at(j, c), f'{j}_{c}') for j in ('head', 'wrist_l', 'wrist_r') for c in 'xyz')} FROM body",
    "scale_table": f"WITH {FRAMES}, d AS (SELECT label, {_TRUNK} AS d FROM raw) SELECT label, count(*)::BIGINT AS n, {_R('median(d)', 'median')}, {_R('stddev_samp(d)', 'sd')}, {_R('stddev_samp(d) / avg(d)', 'cv')} FROM d WHERE d > 0 GROUP BY 1",
    "angles_features": f"""WITH {BODY} SELECT label, {", ".join(_R(f"avg(degrees(({_angle_sql(a, 'l')} + {_angle_sql(a, 'r')}) / 2))", a) for a in G.ANGLES)},
 {", ".join(_R(f"avg(abs(degrees(atan2({_LEAN[c]}, greatest(abs({_LEAN['z']}), 1e-12::DOUBLE)))))", n) for c, n in (("x", "trunk_sagittal"), ("y", "trunk_frontal")))} FROM body GROUP BY 1""",
    "symmetry_feature": f"WITH {BODY} SELECT label, {_R(f'100 * avg(abs({_SIDE['l']} - {_SIDE['r']}) / (0.5::DOUBLE * (abs({_SIDE['l']}) + abs({_SIDE['r']})) + 1e-9::DOUBLE))', 'asymmetry')} FROM body GROUP BY 1",
    "pelvis_features": f"""WITH {BODY}, q AS (SELECT label, frame, t, trunk, {", ".join(f"{_at('pelvis', c)} AS {c}" for c in "xyz")} FROM body), d AS (SELECT *, sqrt({" + ".join(f"pow({c} - lag({c}) OVER w, 2)" for c in "xyz")}) AS step FROM q WINDOW w AS (PARTITION BY label ORDER BY frame)),
 f AS (SELECT label, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS dispersion, sum(step) AS path, max(t) - min(t) AS duration, max(trunk) AS trunk FROM d GROUP BY 1)
 SELECT label, {_R('dispersion', 'dispersion')}, {_R('path', 'path')}, {_R('duration', 'duration')}, {_R('dispersion / trunk', 'dispersion_scaled')}, {_R('path / trunk', 'path_scaled')} FROM f""",
    "velocity_features": f"""WITH {BODY}, n AS (SELECT label, frame, {", ".join(f"{x} AS {n}" for n, x in zip(_NAMES, _EXPRS))} FROM body), d AS (SELECT label, {", ".join(map(_slope, _NAMES))} FROM n WINDOW w AS (PARTITION BY label ORDER BY frame)),
 p AS (SELECT label, unnest([{", ".join(f"abs(degrees({n}))" for n in _NAMES[:10])}]) AS v FROM d), a AS (SELECT label, max(v) AS peak, quantile_cont(v, 0.95) AS p95, sqrt(avg(v * v)) AS rms FROM p GROUP BY 1),
 s AS (SELECT label, median(({" + ".join(f"sqrt({' + '.join(f'pow(e_{e}_{c}, 2)' for c in 'xyz')})" for e in G.ENDPOINTS)}) / 5) AS speed FROM d GROUP BY 1) SELECT label, {", ".join(_R(c, c) for c in ("peak", "p95", "rms", "speed"))} FROM a JOIN s USING (label)""",
    "jump_outliers": f"""WITH {FRAMES}, p AS (SELECT label, frame, j, e[3 * j + 1] AS x, e[3 * j + 2] AS y, e[3 * j + 3] AS z FROM raw, range(0, 21) AS r(j)), d AS (SELECT * FROM (SELECT label, j, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS d FROM p WINDOW w AS (PARTITION BY label, j ORDER BY frame)) WHERE d IS NOT NULL),
 m AS (SELECT label, j, median(d) AS med FROM d GROUP BY ALL), a AS (SELECT label, j, median(abs(d - med)) AS mad FROM d JOIN m USING (label, j) GROUP BY ALL)
 SELECT label, count(*)::BIGINT AS steps, {_R('avg(CASE WHEN d > med + 10 * (mad + 1e-9::DOUBLE) THEN 1.0::DOUBLE ELSE 0 END)', 'rate')} FROM d JOIN m USING (label, j) JOIN a USING (label, j) GROUP BY 1""",
    "joint_error": f"""WITH {FRAMES}, n AS (SELECT label, max(frame) AS hi FROM raw GROUP BY 1), c AS (SELECT label // 2 AS pair, min(hi) / 30.0::DOUBLE AS hi FROM n GROUP BY 1), g AS (SELECT label, i, c.hi * i / 99.0::DOUBLE * 30 AS f FROM n JOIN c ON pair = label // 2, range(0, 100) AS r(i)),
 k AS (SELECT label, i, f, least(floor(f + 1e-9::DOUBLE), (SELECT max(hi) FROM n m WHERE m.label = g.label))::BIGINT AS lo FROM g),
 v AS (SELECT k.label, k.i, j, {", ".join(f"a.e[3 * j + {c}] + CASE WHEN b.e IS NULL THEN 0 ELSE (b.e[3 * j + {c}] - a.e[3 * j + {c}]) * (f - lo) END AS v{c}" for c in (1, 2, 3))} FROM k JOIN raw a ON a.label = k.label AND a.frame = lo LEFT JOIN raw b ON b.label = k.label AND b.frame = lo + 1, range(0, 21) AS r(j))
 SELECT (a.label // 2)::BIGINT AS pair, a.j::INTEGER AS joint, {_R('sqrt(avg(pow(b.v1 - a.v1, 2) + pow(b.v2 - a.v2, 2) + pow(b.v3 - a.v3, 2)))', 'rmse')}, {", ".join(_R(f"avg(b.v{i} - a.v{i})", f"bias_{c}") for i, c in ((1, "x"), (2, "y"), (3, "z")))}
 FROM v a JOIN v b ON a.label % 2 = 0 AND b.label = a.label + 1 AND a.i = b.i AND a.j = b.j GROUP BY ALL""",
    "lowpass_zero_phase": _filter_sql(),
    "sparc": f"""WITH w AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: abs(x)) AS v FROM embeddings), s AS (SELECT vec_id, v, len(v) AS n, unnest(range(0, len(v))) AS t FROM w), b AS (SELECT vec_id, n, k, sum(v[t + 1] * cos(2 * pi() * k * t / n)) AS c, sum(v[t + 1] * sin(2 * pi() * k * t / n)) AS d FROM s, range(0, 33) AS r(k) GROUP BY ALL),
 m AS (SELECT vec_id, n, k, sqrt(c * c + d * d) AS m FROM b), h AS (SELECT vec_id, n, k, m / CASE WHEN max(m) FILTER (k = 0) OVER p > 1e-12 THEN max(m) FILTER (k = 0) OVER p ELSE max(m) OVER p END AS h FROM m WINDOW p AS (PARTITION BY vec_id)),
 c AS (SELECT vec_id, greatest(1, coalesce(max(k) FILTER (h >= 0.05 AND k * 30.0 / n <= 20), 1)) AS c FROM h GROUP BY 1), l AS (SELECT vec_id, k, h - lag(h) OVER (PARTITION BY vec_id ORDER BY k) AS g FROM h)
 SELECT vec_id, {_R('-sum(sqrt(1.0::DOUBLE / (c * c) + g * g))', 'sparc')} FROM l JOIN c USING (vec_id) WHERE k BETWEEN 1 AND c GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (joint_mapping, body_frame, scale_table, angles_features, symmetry_feature, pelvis_features, velocity_features, jump_outliers, feature_cache, joint_error, lowpass_zero_phase, sparc)}
