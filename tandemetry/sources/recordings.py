"""Recordings: annotations, depth-camera and marker files, participants' metadata, as expressions on the texts of an archive's
members (``archives.members``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .archives import members

__all__ = ["annotations", "depth_frames", "marker_frames", "marker_header", "members", "participants"]

#: Values in a depth-camera frame: a time in ms and 25 joints.
FRAME_VALUES = 76
SEGMENT_KEY = r"(P\d{2})(T\d{2})(C\d{2})(G\d{2})(D\d{2})(S\d{2})"


def annotations(labels: DataFrame, codes: DataFrame) -> DataFrame:
    """(recording, content) of annotation files to recording, ord, gesture, direction, segment, start_s, end_s. A line is a
    time and a code; others are skipped. An annotation ends where the next begins, pauses (_) included; codes is the
    dimension (code, gesture, direction); an unknown code fails."""
    lines = labels.select("recording", F.posexplode(F.split("content", "\r?\n")).alias("ord", "line"))
    fields = lines.select("recording", "ord", F.split(F.trim("line"), r"\s+").alias("f")).filter(F.size("f") == 2)
    w = Window.partitionBy("recording").orderBy("ord")
    timed = fields.select("recording", "ord", F.col("f")[0].cast("double").alias("start_s"), F.col("f")[1].alias("code")).withColumn("end_s", F.lead("start_s").over(w))
    known = timed.filter(F.col("code") != "_").join(codes, "code", "left")
    known = known.filter(F.when(F.col("gesture").isNull(), F.raise_error(F.concat(F.lit("unknown label "), F.col("code"))).cast("boolean")).otherwise(F.lit(True)))
    n = F.row_number().over(Window.partitionBy("recording", "gesture", "direction").orderBy("ord"))
    return known.select("recording", "ord", "gesture", "direction", F.format_string("S%02d", n).alias("segment"), "start_s", "end_s")


def _numbers(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))


def depth_frames(texts: DataFrame) -> DataFrame:
    """(stem, content) to stem, frame, t (s), p (array of points in m)."""
    v = texts.select("stem", _numbers(F.col("content")).alias("v"))
    whole = v.filter(F.when(F.size("v") % FRAME_VALUES != 0, F.raise_error(F.concat(F.lit("broken frames in "), F.col("stem"))).cast("boolean")).otherwise(F.lit(True)))
    rows = whole.select("stem", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size("v") / FRAME_VALUES).cast("int") - 1)), lambda i: F.slice("v", i * FRAME_VALUES + 1, F.lit(FRAME_VALUES)))).alias("frame", "f"))
    return rows.filter(F.size("f") == FRAME_VALUES).select("stem", "frame", (F.col("f")[0] / 1000.0).alias("t"), _points(F.slice("f", 2, FRAME_VALUES - 1)).alias("p"))


def _points(flat: Column) -> Column:
    """Triples in mm as points in m; a NaN is a missing value."""
    at = lambda i: F.nullif(F.get(flat, i), F.lit(float("nan"))) / 1000.0
    return F.transform(F.sequence(F.lit(0), (F.size(flat) / 3).cast("int") - 1), lambda j: F.struct(*(at(j * 3 + k).alias(c) for k, c in enumerate("xyz"))))


def marker_header(texts: DataFrame) -> DataFrame:
    """stem, n_frames, n_markers, frequency, marker_names from the ten header lines."""
    lines = texts.select("stem", F.split("content", "\r?\n").alias("l"))
    value = lambda key: F.get(F.split(F.get(F.filter(F.slice("l", 1, 10), lambda x: x.startswith(key + "\t")), F.lit(0)), "\t"), F.lit(1))
    names = F.get(F.filter(F.slice("l", 1, 10), lambda x: x.startswith("MARKER_NAMES\t")), F.lit(0))
    return lines.select("stem", value("NO_OF_FRAMES").cast("int").alias("n_frames"), value("NO_OF_MARKERS").cast("int").alias("n_markers"), value("FREQUENCY").cast("double").alias("frequency"), F.filter(F.slice(F.split(names, "\t"), 2, F.greatest(F.size(F.split(names, "\t")), F.lit(0))), lambda x: x != "").alias("marker_names"))


def marker_frames(texts: DataFrame) -> DataFrame:
    """(stem, content) to stem, frame, t, p by marker; fails unless the body holds frames x markers x 3 numbers."""
    head = marker_header(texts)
    body = texts.select("stem", _numbers(F.array_join(F.slice(F.split("content", "\r?\n"), 11, 100_000_000), " ")).alias("v")).join(head, "stem")
    good = F.size("v") == F.col("n_frames") * F.col("n_markers") * 3
    body = body.filter(F.when(~good, F.raise_error(F.concat(F.lit("wrong size of "), F.col("stem"))).cast("boolean")).otherwise(F.lit(True)))
    width = F.col("n_markers") * 3
    rows = body.filter("n_frames > 0").select("stem", "frequency", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n_frames") - 1), lambda i: F.slice("v", i * width + 1, width))).alias("frame", "f"))
    return rows.select("stem", "frame", (F.col("frame") / F.col("frequency")).alias("t"), _points(F.col("f")).alias("p"))


def participants(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Tab-separated metadata behind a header line: rows whose first field is P and two digits; the skill is the mean of three."""
    names = ["participant_id", "gender", "age", "weight_kg", "height_cm", "practice_years", "category", "skill1", "skill2", "skill3"]
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).filter(F.col("f")[0].rlike(r"^P\d{2}$") & (F.size("f") >= len(names)))
    kinds = ["string", "string", "double", "double", "double", "double", "string", "double", "double", "double"]
    df = f.select(*(F.trim(F.col("f")[i]).cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))))
    df = df.withColumn("skill_mean", (F.col("skill1") + F.col("skill2") + F.col("skill3")) / 3)
    if expected is not None and df.count() != expected:
        raise ValueError(f"{expected} participants expected")
    return df
