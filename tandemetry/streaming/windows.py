"""Windowed metrics of a stream of measurements, late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import fresh


def windowed(events: DataFrame, time: str, value: str, by: str, width: str, late: str) -> DataFrame:
    """start, by, n, mean, most per tumbling window; works on batches and streams alike."""
    w = events.withWatermark(time, late) if events.isStreaming else events
    g = w.groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    return g.select(F.col("w.start").alias("start"), by, "n", "mean", "most")


def event_windows(spark: SparkSession, path: str, width: str = "1 day", late: str = "1 hour", files_per_batch: int | None = None) -> DataFrame:
    """The windows of all available event files, read as a stream, through a checkpointed query into the shared folder. A
    batch writes the windows that it changed, and a window's last writing counts. State holds open windows only: rows later
    than the watermark are dropped, and the watermark moves between batches, so one batch drops none."""
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema)
    source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source
    stream = source.parquet(path + "*").withColumn("at", F.col("ts").cast("timestamp"))
    state, out = fresh(spark, "stream-state"), fresh(spark, "stream-out")
    made = windowed(stream, "at", "value", "event_type", width, late)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = made.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    last = F.max(F.struct("batch", "n", "mean", "most")).alias("w")
    return spark.read.parquet(out).groupBy("start", "event_type").agg(last).select("start", "event_type", "w.n", "w.mean", "w.most")
