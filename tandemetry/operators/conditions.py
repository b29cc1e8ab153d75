"""Preprocessing conditions of a trajectory, and the sixteen features of each: the composed feature table.

A trajectory is sorted by joint, so a task holds one joint's samples and one batch at a time; NumPy filters them in time linear
in their number, at the trajectory's own rate. A condition is a sequence of steps, so that filtering before and after resampling can
be compared. The features come from the operators of ``geometry`` on all conditions at once, one key per condition.

Defined results: a coordinate that is null, NaN or infinite is filled linearly by index, by the nearest value at the ends,
by 0 where a joint has none; rows whose time doesn't increase are left out of a resampling's knots; a null trajectory key is
a key of its own; an empty table gives no rows; repeated frames count as samples of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.recurrence import Cascade
from ..functions.signal import PAD, arc_length, biquads
from ..sources.tables import with_package, written
from . import geometry as G
from .batches import changes, whole
from .timeseries import gradient

CUTOFF, RATE = 6.0, 30.0


def filled(v: np.ndarray) -> np.ndarray:
    good = np.isfinite(v)
    at = np.arange(len(v))
    return np.interp(at, at[good], v[good]) if good.any() else np.zeros(len(v))


@lru_cache(maxsize=64)
def _cascade(cutoff: float, rate: float) -> Cascade:
    return Cascade(biquads(cutoff, rate))


def zero_phase(v: np.ndarray, cutoff: float, rate: float) -> np.ndarray:
    """The filter of ``signal.lowpass`` over the rows of v, column by column."""
    n = len(v)
    if n < PAD + 1 or not 0 < cutoff < rate / 2:
        return v
    x = np.concatenate([2 * v[0] - v[PAD:0:-1], v, 2 * v[-1] - v[::-1][1 : PAD + 1]])
    cascade = _cascade(float(cutoff), float(rate))
    for _ in range(2):
        x = cascade.run(x, cascade.steady(x[0]))[0][::-1]
    return x[PAD : PAD + n]


def uniform(t: np.ndarray, v: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """v at 0, 1 / rate, ... up to the last time, and one step more if over half of one remains."""
    keep = np.concatenate([[True], np.diff(t) > 1e-9])
    t, v = t[keep], v[keep]
    n = np.floor(t[-1] * rate)
    n += t[-1] - n / rate > 0.5 / rate
    grid = np.arange(int(n) + 1) / rate
    return grid, np.stack([np.interp(grid, t, c) for c in v.T], 1)


def _own_rate(t: np.ndarray) -> float:
    steps = np.diff(t)
    return 1 / np.median(steps) if len(steps) and np.median(steps) > 0 else 0.0


def resample_then_filter(t, v, cutoff=CUTOFF):
    t, v = uniform(t, v, RATE)
    return t, zero_phase(v, cutoff, RATE)


def fixed_rate(t, v):
    """Times are ignored."""
    return np.arange(len(t)) / RATE, zero_phase(v, CUTOFF, RATE)


def filter_then_resample(t, v, cutoff=CUTOFF):
    return uniform(t, zero_phase(v, cutoff, _own_rate(t)), RATE)


def filter_at_own_rate(t, v):
    return t, zero_phase(v, CUTOFF, _own_rate(t))


def as_it_is(t, v):
    return t, v


CONDITIONS: dict[str, Callable] = {f.__name__: f for f in (resample_then_filter, fixed_rate, filter_then_resample, filter_at_own_rate, as_it_is)}


def preprocessed(pose: DataFrame, key: str = "label", conditions: dict[str, Callable] = CONDITIONS) -> DataFrame:
    """(key, condition, joint, frame, t, x, y, z) under each condition, gaps filled first, times from
    the first sample's on. pose: (key, joint, frame, t, x, y, z)."""
    with_package(pose.sparkSession)
    kind = pose.schema[key].dataType.simpleString()
    rows = pose.select(key, F.col("joint").cast("int").alias("joint"), F.col("frame").cast("double").alias("frame"), *(F.col(c).cast("double").alias(c) for c in ("t", *"xyz")))
    dealt = rows.repartition(key, "joint").sortWithinPartitions(key, "joint", F.asc_nulls_last("frame"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole(batches):
            start = np.concatenate([[0], changes(part), [part.num_rows]])
            t, xyz = _numbers(part, "t"), np.stack([_numbers(part, c) for c in "xyz"], 1)
            made, held = [], 0
            for a, b in zip(start[:-1], start[1:]):
                own, v = t[a:b] - t[a], np.stack([filled(c) for c in xyz[a:b].T], 1)
                for name, of in conditions.items():
                    made.append((a, name, *of(own, v)))
                    held += len(made[-1][2])
                if held >= OUT:
                    yield _made(part, made)
                    made, held = [], 0
            if made:
                yield _made(part, made)

    return dealt.mapInArrow(run, f"{key} {kind}, condition string, joint int, frame long, t double, x double, y double, z double")


#: Rows of a batch that a task gives back.
OUT = 20_000


def _numbers(part: pa.RecordBatch, c: str) -> np.ndarray:
    return part.column(c).to_numpy(zero_copy_only=False).astype(float)


def _made(part: pa.RecordBatch, made: list[tuple]) -> pa.RecordBatch:
    """Rows of (first row, condition, times, coordinates)."""
    size = [len(m[2]) for m in made]
    at = pa.array(np.repeat([m[0] for m in made], size))
    name = pa.array([m[1] for m in made], pa.string()).take(pa.array(np.repeat(np.arange(len(made)), size)))
    v = np.concatenate([m[3] for m in made])
    out = [part.column(0).take(at), name, part.column(1).take(at), np.concatenate([np.arange(n) for n in size]), np.concatenate([m[2] for m in made]), *(np.ascontiguousarray(c) for c in v.T)]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in out], names=[part.schema.names[0], "condition", "joint", "frame", "t", "x", "y", "z"])


def _missing(c: str) -> Column:
    return F.when(F.col(c).isNull() | ~(F.abs(c) < float("inf")), 1.0).otherwise(0.0)


def quality(pose: DataFrame, key: str = "label") -> DataFrame:
    """key, missing_rate (of coordinates, before any is filled), jump_outlier_rate (after; 0 without jumps)."""
    missing = pose.groupBy(key).agg(F.avg(sum(_missing(c) for c in "xyz") / 3).alias("missing_rate"))
    whole = preprocessed(pose, key, {"as_it_is": as_it_is})
    return missing.join(G.jump_outliers(whole, [key]).select(key, F.col("rate").alias("jump")), key, "left").select(key, "missing_rate", F.coalesce("jump", F.lit(0.0)).alias("jump_outlier_rate"))


def endpoint_smoothness(body: DataFrame, key: str) -> DataFrame:
    """Spectral smoothness of the endpoints' mean speed."""
    ends = [(f"e_{e}_{c}", G.point(F.col("p"), e)[c]) for e in G.ENDPOINTS for c in "xyz"]
    flat = body.select(key, "frame", "t", *(c.alias(n) for n, c in ends))
    d = flat.select(key, "frame", *(gradient([key], "frame", "t", n).alias(n) for n, _ in ends))
    speed = sum(F.sqrt(sum(F.col(f"e_{e}_{c}") * F.col(f"e_{e}_{c}") for c in "xyz")) for e in G.ENDPOINTS) / len(G.ENDPOINTS)
    signal = d.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("frame", speed.alias("v")))), lambda s: s["v"]).alias("v"))

    @F.pandas_udf("double")
    def length(signals: pd.Series) -> pd.Series:
        return pd.Series([arc_length(np.asarray(s, float), RATE) for s in signals], dtype="Float64")

    with_package(body.sparkSession)
    return signal.select(key, length("v").alias("sparc"))


def extracted(made: DataFrame, key: str = "label") -> DataFrame:
    """key, condition, sixteen features of preprocessed trajectories: (key, condition, joint, frame, t, x, y, z)."""
    made = written(made.withColumn("_segment", F.concat_ws("|", F.col(key).cast("string"), "condition")), "made")  # the frames and the names read it
    body = written(G.in_body_frame(G.frames(made, "_segment"), "_segment"), "body")  # four parts read it
    out = made.select("_segment", key, "condition").distinct()
    for part in (G.angle_features(body, "_segment"), G.pelvis_features(body, "_segment"), G.velocity_features(body, "_segment"), endpoint_smoothness(body, "_segment")):
        out = out.join(part, "_segment")
    return out.drop("_segment")


def feature_table(pose: DataFrame, key: str = "label", conditions: dict[str, Callable] = CONDITIONS) -> DataFrame:
    """key, condition, sixteen features, missing_rate, jump_outlier_rate: one row per trajectory and condition."""
    return extracted(preprocessed(pose, key, conditions), key).join(quality(pose, key), key)
