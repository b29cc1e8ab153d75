"""Repeated draws without replacement whose replicates go by the same order, turned: no row is copied by replicate.

A row has a base below ``modulus``; replicate r draws by (base + r * step) mod modulus, then by a tie column, and takes the
first k rows of its group. So all replicates see one order by (base, tie) from different starts, and what a replicate takes is
a stretch of it, whose sums are differences of running sums, or the sums of whole bases and of a part of one more.
Rows without a base are last in every replicate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import with_package, written
from .batches import changes, whole


def starts(base: np.ndarray, reps: int, step: int, modulus: int) -> np.ndarray:
    """Per replicate the first row of the sorted bases in its order."""
    first = (-np.arange(reps, dtype=np.int64) * step) % modulus
    return np.searchsorted(base, first) % max(1, len(base))


def taken(base: np.ndarray, value: np.ndarray, k: int, reps: int, step: int, modulus: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of values, their sum) among the first k rows of each replicate. base is sorted, those of ``modulus`` last;
    values that are missing are NaN and aren't counted."""
    n, known = len(base), int(np.searchsorted(base, modulus))
    at = starts(base[:known], reps, step, modulus)
    there = ~np.isnan(value)
    filled = np.where(there, value, 0.0)
    if not np.isfinite(filled).all():  # an infinity would stay in a running sum
        order = [np.concatenate([np.roll(np.arange(known), -a), np.arange(known, n)])[:k] for a in at]
        return np.array([there[o].sum() for o in order]), np.array([filled[o].sum() for o in order])
    turn, rest = min(k, known), k - min(k, known)
    out = []
    for v in (there.astype(float), filled):
        run = np.concatenate([[0.0], np.cumsum(np.concatenate([v[:known], v[:known]]))])
        out.append(run[at + turn] - run[at] + v[known : known + rest].sum())
    return np.rint(out[0]).astype(np.int64), out[1]


def group_sums(rows: DataFrame, groups: list[str], tie: str, value: str, add: Callable, width: int) -> DataFrame:
    """(rep, s: array of ``width`` doubles), the sums over all groups of what ``add(kind, base, value)`` gives for one: an
    array (rep, width). rows: (groups, base, tie, value), a group by the first of ``groups``, kind being the second, if there is
    one, else None; sorted by kind, base and tie. A group is in one task, as narrow rows."""
    with_package(rows.sparkSession)
    dealt = rows.select(*groups, F.col("base").cast("long").alias("base"), F.col(value).cast("double").alias("value"), tie).repartition(groups[0])
    dealt = dealt.sortWithinPartitions(*groups, F.asc_nulls_last("base"), F.asc_nulls_last(tie)).drop(tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in whole(batches, 1):
            edges = np.concatenate([[0], changes(part, 1), [part.num_rows]])
            kind = part.column(1).to_numpy(zero_copy_only=False) if len(groups) > 1 else None
            base, v = (part.column(c).to_numpy(zero_copy_only=False) for c in ("base", "value"))
            for a, b in zip(edges[:-1], edges[1:]):
                found = add(None if kind is None else kind[a:b], base[a:b], v[a:b])
                if found is not None:
                    total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["rep", "s"])

    parts = dealt.mapInArrow(run, "rep int, s array<double>")
    return parts.groupBy("rep").agg(F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).alias("s"))


def cell_means(rows: DataFrame, sizes: DataFrame, cells: list[str], values: list[str], tie: list[str], reps: int, step: int, modulus: int) -> DataFrame:
    """(rep, feature, n, mean) of the first k rows of each cell, over all cells. rows: (cells, base, values); sizes: (cells, k); tie:
    the columns that part equal bases. A cell has ``modulus`` bases at most, whatever its rows. Sums by base tell which bases a
    replicate takes whole; of the one it takes in part, the rows themselves are read and numbered."""
    with_package(rows.sparkSession)
    of = rows.withColumn("base", F.coalesce("base", F.lit(modulus)).cast("int"))
    sums = [F.sum(v).alias(f"s_{v}") for v in values] + [F.count(v).alias(f"c_{v}") for v in values]
    names = [a for v in values for a in (f"s_{v}", f"c_{v}")]
    bases = of.groupBy(*cells, "base").agg(F.count(F.lit(1)).alias("n"), *sums).join(F.broadcast(sizes), cells)
    kinds = "".join(f"{c} {of.schema[c].dataType.simpleString()}, " for c in cells)

    def whole_bases(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("base")
        base, n, k = group["base"].to_numpy(), group["n"].to_numpy(), int(group["k"].iloc[0])
        known, v, out = int(np.searchsorted(base, modulus)), group[names].fillna(0.0).to_numpy(float), []
        for r, at in enumerate(starts(base[:known], reps, step, modulus)):
            order = np.concatenate([np.roll(np.arange(known), -at), np.arange(known, len(base))])
            ends = np.cumsum(n[order])
            full = int(np.searchsorted(ends, k, side="right"))
            rest = k - int(ends[full - 1] if full else 0)
            out.append((r, k, base[order[full]] if rest else -1, rest, *v[order[:full]].sum(0)))
        return pd.DataFrame(out, columns=["rep", "k", "base", "rest", *names]).assign(**{c: group[c].iloc[0] for c in cells})[[*cells, "rep", "k", "base", "rest", *names]]

    kinds += "rep int, k long, base int, rest long"
    found = written(bases.groupBy(*cells).applyInPandas(whole_bases, kinds + "".join(f", {a} double" for a in names)), "whole_bases")
    part = found.filter("rest > 0").select(*cells, "rep", "base", "rest")
    own = of.join(F.broadcast(part.select(*cells, "base").distinct()), [*cells, "base"])
    alike = own.groupBy(*cells, "base", *dict.fromkeys([*tie, *values])).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*cells, "base").orderBy(*(F.asc_nulls_last(c) for c in dict.fromkeys([*tie, *values])))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = alike.withColumn("before", before).join(F.broadcast(part), [*cells, "base"])
    m = F.least(F.col("n"), F.col("rest") - F.col("before"))
    some = some.filter(m > 0).select("rep", F.lit(0).cast("long").alias("k"), *(e for v in values for e in ((F.col(v) * m).alias(f"s_{v}"), F.when(F.col(v).isNotNull(), m.cast("double")).alias(f"c_{v}"))))
    both = found.select("rep", "k", *names).unionByName(some).groupBy("rep").agg(F.sum("k").alias("n"), *(F.sum(a).alias(a) for a in names))
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("feature"), F.col(f"s_{v}").alias("s"), F.col(f"c_{v}").alias("c")) for v in values)))
    return both.select("rep", "n", each.alias("f")).select("rep", "f.feature", "n", (F.col("f.s") / F.nullif(F.col("f.c"), F.lit(0.0))).alias("mean"))
