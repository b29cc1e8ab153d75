"""The study's entities over the driver's tables: paired measurements, trajectories, intervals. Lazy DataFrames throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Features of an observation, in declared order.
FEATURES = ("quantity", "extendedprice", "discount", "tax")
CONDITIONS = ("A", "N", "R")
#: participants' bands by label.
JOINTS = 21
RATE = 30.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """A zone-free time as seconds; the session's zone is UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant, gesture, sensor (F the reference, O the other), condition, features: one row per observation."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_linestatus", "l_returnflag", *(f"l_{f}" for f in FEATURES))
    who = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = line.join(who, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        F.col("s_nationkey").alias("participant"), F.col("l_linenumber").alias("gesture"), F.col("l_linestatus").alias("sensor"),
        F.col("l_returnflag").alias("condition"), *(F.col(f"l_{f}").alias(f) for f in FEATURES),
    )


def cells(observed: DataFrame, *more: str) -> DataFrame:
    """Means by participant, gesture (and more keys) and sensor, as (…, sensor, feature, value)."""
    keys = ["participant", "gesture", *more]
    means = observed.groupBy(*keys, "sensor").agg(*(F.avg(f).alias(f) for f in FEATURES))
    return means.unpivot([*keys, "sensor"], list(FEATURES), "feature", "value")


def paired(observed: DataFrame, *more: str) -> DataFrame:
    """One row per cell and feature with the reference's value x and the other sensor's y; cells without both are left out."""
    keys = ["participant", "gesture", *more, "feature"]
    wide = cells(observed, *more).groupBy(*keys).pivot("sensor", ["F", "O"]).agg(F.first("value"))
    return wide.select(*keys, F.col("F").alias("x"), F.col("O").alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant, label: the mean balance of the nation's customers."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("participant")).agg(F.avg("c_acctbal").alias("label"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, frame, t (seconds since the user's first event), v: an irregular trajectory per user."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", seconds(F.col("ts")).alias("at"), F.col("value").alias("v"))
    by_time = Window.partitionBy("user_id").orderBy("at", "event_id")
    first = F.min("at").over(Window.partitionBy("user_id"))
    return ev.select("user_id", F.row_number().over(by_time).cast("long").alias("frame"), (F.col("at") - first).alias("t"), "v")


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, frame, t, joint, x, y, z: the elements of a label's vectors as a moving figure of 21 joints at 30 Hz."""
    vec = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    numbered = vec.withColumn("frame", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long") - 1)
    joints = F.transform(F.sequence(F.lit(0), F.lit(JOINTS - 1)), lambda j: F.struct(j.alias("joint"), *(F.get("e", j * 3 + i).alias(c) for i, c in enumerate("xyz"))))
    return numbered.select("label", "frame", (F.col("frame") / F.lit(RATE)).alias("t"), F.explode(joints).alias("j")).select("label", "frame", "t", "j.*")


def uneven_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pose`` as an instrument of another rate records it: the step before a frame is 0.5 to 1.5 of a 60th of a second, by
    the event of the vector's number, and every thirteenth coordinate x is missing."""
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), (F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1000003)) / 1000003.0).alias("u"))
    vec = table(spark, sf_dir, "embeddings").select("label", "vec_id")
    by_id = Window.partitionBy("label").orderBy("vec_id")
    step = (F.coalesce("u", F.lit(0.5)) + 0.5) / 60.0
    times = vec.join(ev, "vec_id", "left").select("label", "vec_id", (F.row_number().over(by_id).cast("long") - 1).alias("frame"), step.alias("step"))
    times = times.withColumn("at", F.sum("step").over(by_id.rowsBetween(Window.unboundedPreceding, 0)) - F.first("step").over(by_id))
    whole = pose(spark, sf_dir).join(times.select("label", "frame", F.col("at").alias("time")), ["label", "frame"])
    missing = F.pmod(F.col("frame") + F.col("joint"), F.lit(13)) == 0
    return whole.select("label", "frame", F.col("time").alias("t"), "joint", F.when(~missing, F.col("x")).alias("x"), "y", "z")


def wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, v (array): each vector as a signal of 64 samples at 30 Hz."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner, ord, start_s, end_s: each customer's orders as annotations that end where the next begins."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), "o_orderkey", F.col("o_orderstatus").alias("code"), seconds(F.col("o_orderdate")).alias("start_s"))
    by_time = Window.partitionBy("owner").orderBy("start_s", "o_orderkey")
    return o.select("owner", F.row_number().over(by_time).cast("long").alias("ord"), "code", "start_s", F.lead("start_s").over(by_time).alias("end_s"))
