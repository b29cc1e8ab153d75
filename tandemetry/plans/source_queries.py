"""Queries through the sources: trajectories by way of archives, features kept between runs; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..sources.archives import members, write_members
from ..sources.feature_store import incremental
from ..sources.recordings import marker_frames, marker_header
from ..sources.tables import fresh
from .geometry_queries import FRAMES
from .views import JOINTS, RATE, pose, seconds, series, table

#: Frames in a member, and bytes of an archive that a task reads.
BLOCK, SPLIT = 64, 1 << 20
#: Seconds at the end of the events that the first run of the store hasn't seen.
RECENT = 21600.0


def marker_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, content): each label's frames as marker files of 64 frames, in mm."""
    p = pose(spark, sf_dir).withColumn("block", F.floor(F.col("frame") / BLOCK))
    mm = F.concat_ws("\t", *[F.coalesce((F.col(c) * 1000.0).cast("string"), F.lit("NaN")) for c in "xyz"])
    rows = p.groupBy("label", "block", "frame").agg(F.sort_array(F.collect_list(F.struct("joint", mm.alias("v")))).alias("l"))
    rows = rows.select("label", "block", "frame", F.array_join(F.transform("l", lambda j: j["v"]), "\t").alias("line"))
    files = rows.groupBy("label", "block").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("frame", "line"))), lambda r: r["line"]), "\n").alias("body"))
    names = "\t".join(["MARKER_NAMES", *(f"J{j}" for j in range(JOINTS))])
    head = [F.format_string("NO_OF_FRAMES\t%d", "n"), F.lit("NO_OF_CAMERAS\t8"), F.lit(f"NO_OF_MARKERS\t{JOINTS}"), F.lit(f"FREQUENCY\t{RATE:g}"), *[F.lit("NONE\t0")] * 5, F.lit(names)]
    return files.select(F.format_string("L%d-B%06d", "label", "block").alias("stem"), F.concat_ws("\n", *head, "body").alias("content"))


def archive_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories written to archives and read back by ranges of their bytes: frames by the headers, mean place by joint."""
    folder = fresh(spark, "archives")
    write_members(marker_texts(spark, sf_dir), folder, ".tsv").agg(F.sum("n")).collect()
    label = F.regexp_extract("stem", r"^L(-?\d+)", 1).cast("int").alias("label")
    heads = marker_header(members(spark, folder, ".tsv", lines=10, split_bytes=SPLIT)).groupBy(label).agg(F.sum("n_frames").alias("n_frames"))
    points = marker_frames(members(spark, folder, ".tsv", split_bytes=SPLIT)).select(label, F.posexplode("p").alias("joint", "q"))
    means = points.groupBy("label", "joint").agg(F.count(F.lit(1)).alias("n"), *(r6(F.avg(f"q.{c}")).alias(c) for c in "xyz"))
    return means.join(heads, "label").select("label", "joint", "n", "n_frames", "x", "y", "z")


def _motion(rows: DataFrame) -> DataFrame:
    """user_id, n, path (of the value), duration."""
    step = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("user_id").orderBy("frame")))
    return rows.withColumn("step", step).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("path"), F.max("t").alias("duration"))


def feature_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store filled before the last six hours of events, then brought up to date: only users with new events are extracted again."""
    store = fresh(spark, "features")
    whole = series(spark, sf_dir)
    at = table(spark, sf_dir, "events").select("user_id", seconds(F.col("ts")).alias("at"))
    last = at.agg((F.max("at") - RECENT).alias("cut"))
    first = at.groupBy("user_id").agg(F.min("at").alias("first"))
    past = whole.join(first, "user_id").join(F.broadcast(last)).filter(F.col("first") + F.col("t") < F.col("cut")).select(*whole.columns)
    incremental(past, "user_id", store, "1", _motion)
    out = incremental(whole, "user_id", store, "1", _motion)
    return out.select("user_id", "n", r6("path").alias("path"), r6("duration").alias("duration"), "extracted")


_R = lambda c, n: f"round({c}, 6) + 0.0 AS {n}"
SQL = {
    "archive_frames": f"""WITH {FRAMES}, c AS (SELECT label, count(*) AS n FROM raw GROUP BY 1)
 SELECT label::INTEGER AS label, j::INTEGER AS joint, count(*)::BIGINT AS n, max(n)::BIGINT AS n_frames, {", ".join(_R(f"avg(e[3 * j + {i}])", c) for i, c in ((1, "x"), (2, "y"), (3, "z")))}
 FROM raw JOIN c USING (label), range(0, {JOINTS}) AS r(j) GROUP BY label, j""",
    "feature_store": f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts::TIMESTAMP) / 1e6::DOUBLE AS sec, value AS v FROM events), d AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY user_id ORDER BY sec, event_id)) AS step FROM e)
 SELECT user_id, count(*)::BIGINT AS n, {_R('sum(step)', 'path')}, {_R('max(sec) - min(sec)', 'duration')}, max(sec) >= (SELECT max(sec) - {RECENT} FROM e) AS extracted FROM d GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (archive_frames, feature_store)}
