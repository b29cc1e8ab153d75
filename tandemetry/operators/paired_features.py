"""Features of two instruments' trajectories of one segment, for the comparisons of a study: preparations of either, scales,
cutoffs, windows moved by a trusted lag, and shifted boundaries.

Each (segment, instrument, preparation) is prepared and extracted once. A scale changes three of the sixteen features, and
these in proportion, so a comparison is a row of a small dimension (comparison, sensor, preparation, scale) that is joined
with the features: what several comparisons share isn't extracted twice.

Defined results: a participant without a positive trunk length, where its scale is asked for, fails; a segment that one
instrument lacks has no rows; a null key has none; under eight common frames there is no lag-corrected row.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from . import conditions as C
from . import geometry as G
from . import timeseries as T

REFERENCE, OTHER = "reference", "other"
CUTOFFS = (4.0, 8.0)
#: Features that a scale divides.
SCALED = ("dispersion", "path", "speed")
FEATURES = (*G.ANGLES, "trunk_sagittal", "trunk_frontal", "asymmetry", "dispersion", "path", "duration", "peak", "p95", "rms", "speed", "sparc")
PREPARATIONS = {
    REFERENCE: {"matched": C.filter_then_resample, "rate_only": C.filter_at_own_rate, "native": C.as_it_is} | {f"matched_{c:g}": partial(C.filter_then_resample, cutoff=c) for c in CUTOFFS},
    OTHER: {"timed": C.resample_then_filter, "fixed": C.fixed_rate} | {f"timed_{c:g}": partial(C.resample_then_filter, cutoff=c) for c in CUTOFFS},
}
#: Comparison: preparation and scale of the reference, then of the other instrument.
COMPARISONS = {
    "primary": (("matched", "own"), ("timed", "own")),
    "fixed_rate": (("matched", "own"), ("fixed", "own")),
    "scale_none": (("matched", "none"), ("timed", "none")),
    "scale_shared": (("matched", "own"), ("timed", "shared")),
    "rate_only": (("rate_only", "own"), ("timed", "own")),
    "native": (("native", "own"), ("timed", "own")),
} | {f"cutoff_{c:g}": ((f"matched_{c:g}", "own"), (f"timed_{c:g}", "own")) for c in CUTOFFS}
#: Samples per second of the search for a lag, its windows, the least correlation of a trusted lag, the least frames.
LAG_RATE, WINDOWS, TRUSTED, LEAST = 60, (30, 60), 0.5, 8


def trunk_scales(poses: DataFrame) -> DataFrame:
    """(participant, sensor, scale): the median positive trunk length over all frames. poses: (participant, sensor, key, frame,
    joint, x, y, z)."""
    ends = [G.JOINTS.index(j) for j in ("pelvis", "spine_shoulder")]
    at = lambda j, c: F.max(F.when(F.col("joint") == j, F.col(c)))
    gap = [(at(ends[1], c) - at(ends[0], c)).alias(f"d{c}") for c in "xyz"]
    length = F.sqrt(sum(F.col(f"d{c}") * F.col(f"d{c}") for c in "xyz"))
    frames = poses.filter(F.col("joint").isin(ends)).groupBy("participant", "sensor", "segment", "frame").agg(*gap)
    lengths = frames.select("participant", "sensor", length.alias("d")).filter((F.col("d") > 0) & (F.col("d") < float("inf")))
    return lengths.groupBy("participant", "sensor").agg(F.percentile("d", F.lit(0.5)).alias("scale"))


def prepared(poses: DataFrame) -> DataFrame:
    """(segment, sensor, condition, joint, frame, t, x, y, z) under every preparation of its instrument; a written table."""
    parts = [C.preprocessed(poses.filter(F.col("sensor") == s), "segment", of).withColumn("sensor", F.lit(s)) for s, of in PREPARATIONS.items()]
    return written(parts[0].unionByName(parts[1]), "prepared")


def _extracted(made: DataFrame) -> DataFrame:
    """(segment, sensor, preparation, features) of prepared trajectories."""
    both = made.withColumn("_key", F.concat_ws("|", "segment", "sensor"))
    names = both.select("_key", "segment", "sensor").distinct()
    return C.extracted(both, "_key").join(names, "_key").select("segment", "sensor", F.col("condition").alias("preparation"), *FEATURES)


def compared(features: DataFrame, who: DataFrame, scales: DataFrame, comparisons: dict = COMPARISONS) -> DataFrame:
    """(segment, participant, comparison, sensor, scale, features) of each comparison. who: (segment, participant)."""
    rows = [(name, sensor, prep, scale) for name, both in comparisons.items() for sensor, (prep, scale) in zip((REFERENCE, OTHER), both)]
    dim = features.sparkSession.createDataFrame(rows, "comparison string, sensor string, preparation string, by string")
    wanted = features.join(F.broadcast(dim), ["sensor", "preparation"]).join(who, "segment")
    wanted = wanted.withColumn("_of", F.when(F.col("by") == "own", F.col("sensor")).when(F.col("by") == "shared", F.lit(REFERENCE)))
    known = scales.select("participant", F.col("sensor").alias("_of"), F.col("scale").alias("_scale"))
    out = wanted.join(known, ["participant", "_of"], "left")
    fails = F.raise_error(F.concat(F.lit("no scale of "), F.coalesce(F.col("participant").cast("string"), F.lit("null")))).cast("double")
    scale = F.when(F.col("by") == "none", 1.0).otherwise(F.coalesce("_scale", fails))
    out = out.withColumn("scale", scale)
    return out.select("segment", "participant", "comparison", "sensor", "scale", *((F.col(f) / F.col("scale")).alias(f) if f in SCALED else F.col(f) for f in FEATURES))


def pelvis_speed(made: DataFrame) -> DataFrame:
    """(segment, sensor, t, v): the pelvis's speed under the primary preparations; a turn and a shift don't change it."""
    primary = ((F.col("sensor") == REFERENCE) & (F.col("condition") == "matched")) | ((F.col("sensor") == OTHER) & (F.col("condition") == "timed"))
    p = made.filter(primary & (F.col("joint") == G.JOINTS.index("pelvis")))
    d = p.select("segment", "sensor", "t", *(T.gradient(["segment", "sensor"], "frame", "t", c).alias(c) for c in "xyz"))
    return d.select("segment", "sensor", "t", F.sqrt(sum(F.col(c) * F.col(c) for c in "xyz")).alias("v"))


def lags(speed: DataFrame) -> DataFrame:
    """(segment, window, lag, r, on_edge), lag and window in 60ths of a second: the best correlation of the two speeds. Segments
    of a quarter of a second or less have no lag."""
    ends = speed.groupBy("segment", "sensor").agg(F.max("t").alias("end")).groupBy("segment").agg(F.min("end").alias("end"), F.count(F.lit(1)).alias("n"))
    n = F.ceil(F.col("end") * LAG_RATE - 1e-9)
    grid = ends.filter((F.col("n") == 2) & (F.col("end") > 0.25)).select("segment", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    grid = grid.withColumn("t", F.col("i") / F.lit(float(LAG_RATE)))
    q, k = (T.interpolate(speed.filter(F.col("sensor") == s), grid, "segment").select("segment", "i", F.col("v").alias(n)) for s, n in ((REFERENCE, "q"), (OTHER, "k")))
    edge = max(WINDOWS)
    return T.best_lags(T.overlap_correlations(q.join(k, ["segment", "i"]), "segment", range(-edge, edge + 1), LEAST), "segment", WINDOWS)


def lag_corrected(made: DataFrame, found: DataFrame) -> DataFrame:
    """(segment, sensor, condition, joint, frame, t, x, y, z): both primary trajectories on one grid of their common time, the
    other's moved by its trusted lag."""
    good = found.filter((F.col("window") == max(WINDOWS)) & (F.col("r") >= TRUSTED) & ~F.col("on_edge")).select("segment", (F.col("lag") / F.lit(float(LAG_RATE))).alias("lag_s"))
    primary = made.filter(F.col("condition") == F.when(F.col("sensor") == REFERENCE, "matched").otherwise("timed"))
    moved = primary.join(good, "segment").withColumn("t", F.col("t") + F.when(F.col("sensor") == OTHER, F.col("lag_s")).otherwise(0.0))
    ends = moved.groupBy("segment", "sensor").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).groupBy("segment").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    n = F.floor((F.col("hi") - F.col("lo") + 1e-9) * C.RATE)
    grid = ends.filter(n + 1 >= LEAST).select("segment", "lo", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("i"))
    series = moved.withColumn("_key", F.concat_ws("|", "segment", "sensor", "joint"))
    names = series.select("_key", "segment", "sensor", "joint").distinct()
    wanted = names.join(grid, "segment").select("_key", "i", (F.col("lo") + F.col("i") / F.lit(C.RATE)).alias("t"))
    at = T.interpolate(series, wanted, "_key", "t", ("x", "y", "z")).join(names, "_key")
    return at.select("segment", "sensor", F.lit("lagged").alias("condition"), "joint", F.col("i").alias("frame"), (F.col("i") / F.lit(C.RATE)).alias("t"), "x", "y", "z")


def paired_features(poses: DataFrame) -> DataFrame:
    """(segment, participant, comparison, sensor, scale, features) of every comparison, the lag-corrected one included. poses:
    (participant, segment, sensor, joint, frame, t, x, y, z); only segments that both instruments have."""
    twice = poses.groupBy("segment").agg(F.count_distinct("sensor").alias("n"), F.first("participant").alias("participant")).filter("n = 2")
    who = written(twice.select("segment", "participant"), "segments")
    of = poses.drop("participant").join(who, "segment")
    made = prepared(of)
    moved = lag_corrected(made, lags(pelvis_speed(made)))
    features = _extracted(made.unionByName(moved, allowMissingColumns=True))
    both = ("lagged", "own")
    return compared(features, who, trunk_scales(of), COMPARISONS | {"lag_corrected": (both, both)})


def shifted_features(recording: DataFrame, bounds: DataFrame, shifts: range = range(-2, 3), least: int = LEAST) -> DataFrame:
    """(segment, shift, features) of segments cut from recordings, both bounds moved by each shift and clamped to the recording,
    under the other instrument's primary preparation. recording: (recording, joint, frame, t, x, y, z); bounds: (recording,
    segment, start, stop). Intervals under ``least`` frames have no row."""
    edge = recording.groupBy("recording").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    s = bounds.join(edge, "recording").withColumn("shift", F.explode(F.array(*[F.lit(i) for i in shifts])))
    s = s.withColumn("a", F.greatest(F.col("start") + F.col("shift"), F.col("lo"))).withColumn("b", F.least(F.col("stop") + F.col("shift"), F.col("hi")))
    s = s.filter(F.col("b") - F.col("a") + 1 >= least)
    frames = s.select("recording", "segment", "shift", F.explode(F.sequence("a", "b")).alias("frame"))
    cut = frames.join(recording, ["recording", "frame"]).withColumn("_key", F.concat_ws("|", "segment", "shift"))
    names = s.select(F.concat_ws("|", "segment", "shift").alias("_key"), "segment", "shift")
    made = C.preprocessed(cut, "_key", {"timed": C.resample_then_filter})
    return C.extracted(made, "_key").join(names, "_key").select("segment", "shift", *FEATURES)
