"""Features of two instruments: every comparison of the study, windows with moved boundaries; with the SQL of what isn't
filtered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import conditions as C
from ..operators import paired_features as P
from .geometry_queries import SQL as GEOMETRY
from .views import pose, uneven_pose

#: Frames of a segment that is cut from a recording; frames per second of the reference.
SEGMENT, REFERENCE_RATE = 20, 45.0


def two_sensors(spark: SparkSession, sf_dir: str, rate: float = REFERENCE_RATE) -> DataFrame:
    """Labels 2k and 2k + 1 as segment k under the reference, at this rate, and under the other instrument, at uneven times; two
    participants."""
    p = pose(spark, sf_dir).filter(F.col("label") % 2 == 0).withColumn("t", F.col("frame") / F.lit(rate)).withColumn("sensor", F.lit(P.REFERENCE))
    u = uneven_pose(spark, sf_dir).filter(F.col("label") % 2 == 1).withColumn("sensor", F.lit(P.OTHER))
    segment = F.floor(F.col("label") / 2)
    return p.unionByName(u).select((segment % 2).alias("participant"), segment.alias("segment"), "sensor", "joint", "frame", "t", "x", "y", "z")


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(r6(f).alias(f) for f in P.FEATURES))


def paired_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both instruments' features under each comparison."""
    return _rounded(P.paired_features(two_sensors(spark, sf_dir)), "segment", "participant", "comparison", "sensor")


def native_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference at its own rate of 30 Hz, unfiltered, each segment a participant, so by its own trunk."""
    of = two_sensors(spark, sf_dir, 30.0).filter(F.col("sensor") == P.REFERENCE).withColumn("participant", F.col("segment"))
    features = C.extracted(C.preprocessed(of, "segment", {"native": C.as_it_is}), "segment").withColumn("sensor", F.lit(P.REFERENCE)).withColumnRenamed("condition", "preparation")
    out = P.compared(features, of.select("segment", "participant").distinct(), P.trunk_scales(of), {"native": (("native", "own"), ("native", "own"))})
    return _rounded(out, "segment").drop("speed", "sparc")


def shifted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of twenty frames of each label's recording, both bounds moved by up to two frames."""
    recording = uneven_pose(spark, sf_dir).withColumnRenamed("label", "recording")
    starts = recording.filter(F.col("frame") % SEGMENT == 0).select("recording", F.col("frame").alias("start")).distinct()
    bounds = starts.select("recording", F.concat_ws(":", "recording", "start").alias("segment"), "start", (F.col("start") + SEGMENT - 1).alias("stop"))
    return _rounded(P.shifted_features(recording, bounds), "segment", "shift")


SQL = {
    "native_features": f"""SELECT (label // 2)::BIGINT AS segment, knee, hip, ankle, elbow, shoulder, trunk_sagittal, trunk_frontal, asymmetry, dispersion_scaled AS dispersion, path_scaled AS path, duration, peak, p95, rms
 FROM ({GEOMETRY['angles_features']}) JOIN ({GEOMETRY['symmetry_feature']}) USING (label) JOIN ({GEOMETRY['pelvis_features']}) USING (label) JOIN ({GEOMETRY['velocity_features']}) USING (label) WHERE label % 2 = 0""",
}
QUERIES = {f.__name__: f for f in (paired_features, native_features, shifted_features)}
