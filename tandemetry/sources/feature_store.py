"""Features kept between runs: a manifest of (key, digest of the input, version of the code), so that only what is unseen is
extracted.

A key's digest is a sum over its rows, in any order, so it costs one aggregation that folds on the map side; the features
of a run are a folder of their own, and a run counts once the manifest, written last, names it. A run that dies before that has
left nothing that is read; two runs at once may both extract a key, of which one is read.

Defined results: a null key is a key; repeated rows count; a changed, added or dropped row or column changes the digest; a key
whose extraction gives no rows isn't extracted again; keys that aren't in the input any more aren't returned.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Sixty bits of a hash as a number; two of them, and the number of rows, make a digest.
HEX = 15


def digests(rows: DataFrame, key: str) -> DataFrame:
    """(key, digest) of each key's rows, whatever their order."""
    names = sorted(rows.columns)
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in names]), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + i * HEX, HEX), 16, 10).cast("decimal(38,0)"))
    total = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), part(0).alias("a"), part(1).alias("b"))
    return total.select(key, F.sha2(F.concat_ws(":", "n", "a", "b", F.lit(",".join(names))), 256).alias("digest"))


def _read(rows: DataFrame, path: str) -> DataFrame | None:
    try:
        return rows.sparkSession.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def incremental(rows: DataFrame, key: str, path: str, version: str, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``extract(rows)`` gives, with ``extracted``: whether this run did it. extract: rows of some keys to rows that carry
    the key, each key's from its own rows alone; a change of it needs a new version."""
    now = written(digests(rows, key), "digests")
    seen = _read(rows, f"{path}/manifest")
    run = uuid.uuid4().hex
    todo = now
    if seen is not None:
        known = seen.filter(F.col("version") == version).select(F.col(key).alias("_key"), F.col("digest").alias("_digest"))
        todo = now.join(known, _same("_key", key) & (F.col("_digest") == F.col("digest")), "left_anti")
    todo = written(todo, "todo")
    if not todo.isEmpty():
        keys = todo.select(F.col(key).alias("_key"))
        made = extract(rows.join(keys, _same("_key", key), "left_semi"))
        made.write.parquet(f"{path}/features/{run}")
        todo.select(key, "digest", F.lit(version).alias("version"), F.lit(run).alias("run")).write.mode("append").parquet(f"{path}/manifest")
    elif seen is None:
        made = extract(rows.limit(0))
        return made.withColumn("extracted", F.lit(False))
    named = rows.sparkSession.read.parquet(f"{path}/manifest").filter(F.col("version") == version)
    named = named.groupBy(key, "digest").agg(F.max(F.when(F.col("run") == run, run)).alias("mine"), F.min("run").alias("first"))
    current = now.join(named.withColumnRenamed(key, "_key"), _same("_key", key) & (named["digest"] == now["digest"]))
    current = written(current.select("_key", F.coalesce("mine", "first").alias("_run"), F.col("mine").isNotNull().alias("extracted")), "current")
    runs = [r._run for r in current.select("_run").distinct().collect()]  # runs, not keys
    if not runs:
        return extract(rows.limit(0)).withColumn("extracted", F.lit(False))
    stored = rows.sparkSession.read.parquet(*[f"{path}/features/{r}" for r in runs])
    stored = stored.withColumn("_from", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return stored.join(current, _same("_key", key) & (F.col("_run") == F.col("_from"))).drop("_key", "_run", "_from")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))
