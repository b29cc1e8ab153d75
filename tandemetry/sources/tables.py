"""Tables in the shared folder, exports and integrity checks."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on one machine (local mode, as in tests) a folder of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def with_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package even where it isn't installed."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(p for p in (root, env.get("PYTHONPATH", "")) if p)


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: the lineage ends there."""
    path = fresh(df.sparkSession, name)
    # what was shuffled for the table is of no use once it is written
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_once(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path if there is one, else what ``build()`` makes, written there."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, compression="gzip")


def export_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, length, md5, sha256 of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))
