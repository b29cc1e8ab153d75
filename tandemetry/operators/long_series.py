"""Series of any length: the operators of ``timeseries`` and the zero-phase filter, over chunks of a series.

Rows are numbered by ranges (``order_statistics.running``) and cut into chunks of so many consecutive rows, each a window or
a group of its own. What a chunk needs of its neighbours comes as rows marked halo: copies of the rows next to its borders,
or, where the nearest known value may lie any number of chunks away, that value, carried along one small row per chunk. The
filter hands on states: each chunk tells what it adds to a state of zero, a chunk's start follows from the chunks before it,
and only then are outputs computed. Results equal those of one task per series, at any chunk size.

Defined results: as in ``timeseries`` and ``conditions``; a series shorter than the filter's padding stays as it is; nulls
must be filled before filtering; rows that tie in their order are taken in any order, so orders should be unique.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recurrence import Cascade
from ..functions.signal import PAD, biquads
from ..sources.tables import with_package, written
from . import timeseries as T
from .order_statistics import running

CHUNK = 1 << 16


def chunked(rows: DataFrame, key: str, order: list[str], size: int = CHUNK) -> DataFrame:
    """rows with pos (from 0), n (the series' rows) and chunk."""
    numbered = running(rows.withColumn("_one", F.lit(1)), [key], order, "_one").withColumnRenamed("before", "pos")
    return numbered.drop("_one").withColumn("chunk", F.floor(F.col("pos") / size))


def haloed(chunks: DataFrame, size: int, left: int = 0, right: int = 0) -> DataFrame:
    """chunks with halo: also the last ``left`` rows of the chunk before and the first ``right`` of the one after."""
    place = F.col("pos") % size
    targets = F.array(F.col("chunk"), F.when(place >= size - left, F.col("chunk") + 1), F.when((place < right) & (F.col("chunk") > 0), F.col("chunk") - 1))
    to = chunks.withColumn("_to", F.explode(F.array_compact(targets)))
    return to.withColumn("halo", F.col("_to") != F.col("chunk")).withColumn("chunk", F.col("_to")).drop("_to")


def carried(chunks: DataFrame, key: str, known: Column) -> DataFrame:
    """chunks with halo: also, in each chunk, the nearest row before it and the nearest after it for which ``known`` holds."""
    row = F.struct("pos", *(c for c in chunks.columns if c not in ("pos", "chunk", key)))
    ends = chunks.groupBy(key, "chunk").agg(F.max(F.when(known, row)).alias("last"), F.min(F.when(known, row)).alias("first"))
    w = Window.partitionBy(key).orderBy("chunk")  # one row per chunk
    before = F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    found = ends.select(key, "chunk", before.alias("b"), after.alias("a"))
    near = found.select(key, "chunk", F.explode(F.array_compact(F.array("b", "a"))).alias("r")).select(key, "chunk", "r.*")
    return chunks.withColumn("halo", F.lit(False)).unionByName(near.withColumn("halo", F.lit(True)))


def strictly_increasing(df: DataFrame, key: str, order: str, t: str, least: float = 1e-9, size: int = CHUNK) -> DataFrame:
    """``timeseries.strictly_increasing``."""
    wide = haloed(chunked(df, key, [order], size), size, left=1)
    before = F.lag(t).over(Window.partitionBy(key, "chunk").orderBy("pos"))
    return wide.withColumn("_before", before).filter(~F.col("halo") & (F.col("_before").isNull() | (F.col(t) - F.col("_before") > least))).select(*df.columns)


def with_gradient(df: DataFrame, key: str, order: str, t: str, v: str, name: str, size: int = CHUNK) -> DataFrame:
    """df with ``timeseries.gradient`` as name."""
    wide = haloed(chunked(df, key, [order], size), size, 1, 1)
    return wide.withColumn(name, T.gradient([key, "chunk"], "pos", t, v)).filter(~F.col("halo")).select(*df.columns, name)


def with_filled(df: DataFrame, key: str, order: str, v: str, name: str, size: int = CHUNK) -> DataFrame:
    """df with ``timeseries.fill_gaps`` as name: by order, which is a number."""
    wide = carried(chunked(df, key, [order], size), key, F.col(v).isNotNull())
    return wide.withColumn(name, T.fill_gaps([key, "chunk"], order, v)).filter(~F.col("halo")).select(*df.columns, name)


def interpolate(knots: DataFrame, grid: DataFrame, key: str, t: str = "t", values: tuple[str, ...] = ("v",), size: int = CHUNK) -> DataFrame:
    """``timeseries.interpolate``."""
    rows = knots.select(key, t, F.lit(0).alias("side"), F.lit(None).cast("long").alias("i"), *values)
    both = rows.unionByName(grid.select(key, t, F.lit(1).alias("side"), F.col("i").cast("long").alias("i")), allowMissingColumns=True)
    placed = written(carried(chunked(both, key, [t, "side", "i"], size), key, F.col("side") == 0), "placed")
    part = F.struct(F.col(key).alias("k"), "chunk").alias("part")
    out = T.interpolate(placed.filter("side = 0").select(part, t, *values), placed.filter("side = 1").select(part, t, "i"), "part", t, values)
    return out.select(F.col("part.k").alias(key), "i", t, *values)


def uniform_resample(series: DataFrame, key: str, rate: float, t: str = "t", v: str = "v", size: int = CHUNK, order: str | None = None) -> DataFrame:
    """``timeseries.uniform_resample``, of rows in their order (by time if none is given); the grid is made in chunks too."""
    knots = written(strictly_increasing(series, key, order or t, t, size=size).select(key, t, v), "knots")
    n = F.floor(F.col("end") * rate)
    n = (n + F.when(F.col("end") - n / F.lit(rate) > 0.5 / rate, 1).otherwise(0)).cast("long")
    ends = knots.groupBy(key).agg(F.max(t).alias("end")).withColumn("n", n)
    parts = ends.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / size)))).repartition(key, "part")
    first = F.col("part") * size
    grid = parts.select(key, F.explode(F.sequence(first, F.least(F.col("n"), first + size - 1))).alias("i")).withColumn(t, F.col("i") / F.lit(rate))
    return interpolate(knots, grid, key, t, (v,), size)


def _one_way(rows: DataFrame, key: str, values: list[str], cascade: Cascade, size: int) -> DataFrame:
    """rows (key, j, length, values) filtered in the order of j (from 0), starting in the steady state of the first."""
    rows = rows.withColumn("chunk", F.floor(F.col("j") / size))
    kind = rows.schema[key].dataType.simpleString()
    state = "array<array<double>>"

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values("j")[values].to_numpy(float)
        added = cascade.run(x, np.zeros((cascade.size, len(values))))[1]
        return group[[key, "chunk"]].head(1).assign(samples=len(x), added=[added.tolist()], first=[x[0].tolist()])

    def starts(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        now, out = None, []
        for samples, added, first in zip(group["samples"], group["added"], group["first"]):
            now = cascade.steady(np.array(first, float)) if now is None else now
            out.append(now.tolist())
            now = cascade.over(int(samples)) @ now + np.array([list(r) for r in added], float)
        return group[[key, "chunk"]].assign(start=out)

    def outputs(group: pd.DataFrame, begun: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("j")
        start = np.array([list(map(float, r)) for r in begun["start"].iloc[0]])
        out = group[[key, "j", "length"]].copy()
        out[values] = cascade.run(group[values].to_numpy(float), start)[0]
        return out

    seen = rows.groupBy(key, "chunk").applyInPandas(ends, f"{key} {kind}, chunk long, samples long, added {state}, first array<double>")
    begun = seen.groupBy(key).applyInPandas(starts, f"{key} {kind}, chunk long, start {state}")  # one row per chunk
    columns = "".join(f", {v} double" for v in values)
    both = rows.groupBy(key, "chunk").cogroup(begun.groupBy(key, "chunk"))
    return written(both.applyInPandas(outputs, f"{key} {kind}, j long, length long{columns}"), "filtered")


def lowpass(df: DataFrame, key: str, order: str, values: list[str], cutoff: float, rate: float, size: int = CHUNK) -> DataFrame:
    """(key, pos, values): ``signal.lowpass`` of each series' values in their order."""
    with_package(df.sparkSession)
    rows = written(chunked(df.select(key, order, *values), key, [order], size).select(key, "pos", "n", *values), "series")
    if not 0 < cutoff < rate / 2:
        return rows.select(key, "pos", *values)
    cascade = Cascade(biquads(cutoff, rate))
    long = rows.filter(F.col("n") > PAD)
    ends = long.groupBy(key).agg(*(F.min_by(v, "pos").alias(f"_a_{v}") for v in values), *(F.max_by(v, "pos").alias(f"_z_{v}") for v in values))
    last = F.col("n") - 1
    head, tail = F.col("pos").between(1, PAD), F.col("pos").between(last - PAD, last - 1)
    near = long.filter(head | tail).join(ends, key)
    mirrored = [
        near.filter(test).select(key, place.alias("pos"), "n", *((2 * F.col(f"{end}{v}") - F.col(v)).alias(v) for v in values))
        for test, place, end in ((head, -F.col("pos"), "_a_"), (tail, 2 * last - F.col("pos"), "_z_"))
    ]
    padded = long.unionByName(mirrored[0]).unionByName(mirrored[1])
    there = _one_way(padded.select(key, (F.col("pos") + PAD).alias("j"), (F.col("n") + 2 * PAD).alias("length"), *values), key, values, cascade, size)
    turned = F.col("length") - 1 - F.col("j")
    back = _one_way(there.select(key, turned.alias("j"), "length", *values), key, values, cascade, size)
    whole = back.select(key, (turned - PAD).alias("pos"), "length", *values).filter((F.col("pos") >= 0) & (F.col("pos") < F.col("length") - 2 * PAD)).drop("length")
    return whole.unionByName(rows.filter(F.col("n") <= PAD).select(key, "pos", *values))
