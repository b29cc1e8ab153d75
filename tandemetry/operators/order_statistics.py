"""Ranks, exact quantiles and Kendall's tau of groups of any size, by ranges.

Equal values are counted first, in each task and then together. The counted values are dealt out by ranges of (key, value)
and written; running counts stay within a range, and a window over one small row per range and key gives what lies before
it. So a key's values are spread over as many tasks as there are ranges, and none holds a group's distinct values.

Defined results: nulls and NaN have no place; a group without values has no quantiles and no tau; keys may be null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import with_package, written

BLOCK = 1 << 16


def running(counts: DataFrame, keys: list[str], order: list[str], c: str = "c") -> DataFrame:
    """counts (keys, order, c, more) with before, the sum of c of the rows of smaller order in the key, and n, the key's sum."""
    by = [F.asc_nulls_first(k) for k in [*keys, *order]]
    dealt = written(counts.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sums = dealt.groupBy(*keys, "_range").agg(F.sum(c).alias("_inside"))  # a row per range and key
    offsets = sums.select(*keys, "_range", F.coalesce(F.sum("_inside").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"), F.sum("_inside").over(whole).alias("_n"))
    both = dealt.withColumn("_side", F.lit(1)).unionByName(offsets.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    span = Window.partitionBy(*keys, "_range").orderBy("_side", *(F.asc_nulls_first(k) for k in order))
    inside = F.coalesce(F.sum(c).over(span.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = both.select(*counts.columns, "_side", (F.first("_offset").over(span) + inside).alias("before"), F.first("_n").over(span).alias("n"))
    return numbered.filter("_side = 1").drop("_side")


def _counted(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    real = [F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")) for v in values]
    some = df.filter(real[0] if len(real) == 1 else real[0] & real[1])
    return some.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("c"))


def _same(a: list[str], b: list[str]) -> Column:
    on = F.lit(True)
    for x, y in zip(a, b):
        on = on & F.col(x).eqNullSafe(F.col(y))
    return on


def ranked(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """df with rank_<value> for each value, ties sharing their mean rank; null where the value is null or NaN."""
    for v in values:
        places = running(_counted(df, keys, [v]), keys, [v])
        names = [f"_k{i}" for i in range(len(keys))]
        ranks = places.select(*(F.col(k).alias(a) for k, a in zip(keys, names)), F.col(v).alias("_v"), (F.col("before") + (F.col("c") + 1) / 2.0).alias(f"rank_{v}"))
        df = df.join(ranks, _same([*keys, v], [*names, "_v"]), "left").drop("_v", *names)
    return df


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(keys, a column for each of ``at``): exact quantiles by linear interpolation between the two values around the place."""
    places = running(_counted(df, keys, [value]), keys, [value])
    first, last = F.col("before"), F.col("before") + F.col("c") - 1
    sides, ends = [], []
    for name, p in at.items():
        h = (F.col("n") - 1) * F.lit(float(p))
        for side, place in (("low", F.floor(h)), ("high", F.ceil(h))):
            sides.append(F.max(F.when((first <= place) & (place <= last), F.col(value).cast("double"))).alias(f"_{side}_{name}"))
        share = F.col("_n") - 1
        part = share * F.lit(float(p)) - F.floor(share * F.lit(float(p)))
        ends.append((F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * part).alias(name))
    return places.groupBy(*keys).agg(F.max("n").alias("_n"), *sides).select(*keys, *ends)


def inversions(q: np.ndarray, w: np.ndarray) -> float:
    """The sum of w_a w_b over pairs where a stands before b and q_a > q_b, by merging sorted halves."""
    if len(q) <= 64:
        return float((np.triu(q[:, None] > q[None, :], 1) * np.outer(w, w)).sum())
    half = len(q) // 2
    left, right = np.argsort(q[:half], kind="stable"), np.argsort(q[half:], kind="stable")
    heavy = np.append(np.cumsum(w[:half][left][::-1])[::-1], 0.0)
    across = (w[half:] * heavy[np.searchsorted(q[:half][left], q[half:], side="right")]).sum()
    return float(across) + inversions(q[:half], w[:half]) + inversions(q[half:], w[half:])


def tau_b(x: np.ndarray, y: np.ndarray) -> float | None:
    """Kendall's tau-b of two arrays, in n log n."""
    n = len(x)
    order = np.lexsort((y, x))
    ties = lambda *c: (lambda k: float((k * (k - 1) // 2).sum()))(np.unique(np.column_stack(c), axis=0, return_counts=True)[1])
    pairs, tx, ty = n * (n - 1) / 2, ties(x), ties(y)
    if n < 2 or tx == pairs or ty == pairs:
        return None
    discordant = inversions(y[order], np.ones(n))
    return float((pairs - tx - ty + ties(x, y) - 2 * discordant) / np.sqrt(pairs - tx) / np.sqrt(pairs - ty))


def kendall_cells(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, kendall) of many groups that each fit a task."""
    with_package(df.sparkSession)
    kinds = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        some = group.dropna(subset=["_x", "_y"])
        return group[keys].head(1).assign(kendall=tau_b(some["_x"].to_numpy(float), some["_y"].to_numpy(float)))

    pairs = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    return pairs.groupBy(*keys).applyInPandas(solve, kinds + "kendall double")


def kendall(df: DataFrame, keys: list[str], x: str, y: str, block: int = BLOCK, side: int = 1000) -> DataFrame:
    """(keys, kendall): tau-b of groups of any size. Distinct pairs are cut into blocks of places in the order of (x, y) and
    into blocks of y; a value of y with more rows than a block is a block of its own. Discordant pairs are the inversions
    inside blocks of the first kind, those inside blocks of the second that the first keep apart, and pairs of cells (first,
    second) that lie the wrong way round. Blocks are at least ``block`` rows and a ``side``-th of the key's, so a key has
    ``side``^2 cells at most, which one task adds up."""
    with_package(df.sparkSession)
    pairs = _counted(df.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")), keys, ["x", "y"])
    one = running(pairs.withColumn("one", F.lit(1)), keys, ["x", "y"], "one").withColumnRenamed("before", "place").withColumnRenamed("n", "kinds")
    by_y = running(pairs.groupBy(*keys, "y").agg(F.sum("c").alias("c")), keys, ["y"]).withColumnRenamed("c", "heavy")
    size = F.greatest(F.lit(float(block)), F.col("n") / F.lit(float(side)))
    names = [f"_k{i}" for i in range(len(keys))]
    by_y = by_y.select(*(F.col(k).alias(a) for k, a in zip(keys, names)), F.col("y").alias("_y"), "heavy", "n", (2 * F.floor(F.col("before") / size) + (F.col("heavy") > size).cast("int")).alias("v"))
    placed = one.join(by_y, _same([*keys, "y"], [*names, "_y"])).select(*keys, "x", "y", "c", "n", F.floor(F.col("place") / F.greatest(F.lit(float(block)), F.col("kinds") / F.lit(float(side)))).alias("u"), "v")
    placed = written(placed, "pairs")
    kinds = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["x", "y"])
        q, w, other = group["y"].to_numpy(float), group["c"].to_numpy(float), group["other"].to_numpy()
        lost = inversions(q, w)
        if group["kind"].iloc[0]:  # pairs of one cell were counted in their block of places
            lost -= sum(inversions(q[other == u], w[other == u]) for u in np.unique(other))
        return group[keys].head(1).assign(discordant=lost)

    def across(group: pd.DataFrame) -> pd.DataFrame:
        u, v = (np.unique(group[c], return_inverse=True)[1] for c in "uv")
        grid = np.zeros((u.max() + 1, v.max() + 1))
        grid[u, v] = group["m"]
        earlier = np.cumsum(np.vstack([np.zeros(grid.shape[1]), grid[:-1]]), 0)  # blocks of places before
        larger = np.cumsum(earlier[:, ::-1], 1)[:, ::-1]
        larger = np.hstack([larger[:, 1:], np.zeros((len(grid), 1))])  # and blocks of y above
        return group[keys].head(1).assign(discordant=float((grid * larger).sum()))

    both = placed.select(*keys, "x", "y", "c", F.lit(0).alias("kind"), F.col("u").alias("block"), F.col("v").alias("other"))
    both = both.unionByName(placed.filter("v % 2 = 0").select(*keys, "x", "y", "c", F.lit(1).alias("kind"), F.col("v").alias("block"), F.col("u").alias("other")))
    parts = both.groupBy(*keys, "kind", "block").applyInPandas(inside, kinds + "discordant double")
    cells = placed.groupBy(*keys, "u", "v").agg(F.sum("c").alias("m"))
    wrong = parts.unionByName(cells.groupBy(*keys).applyInPandas(across, kinds + "discordant double")).groupBy(*keys).agg(F.sum("discordant").alias("d"))
    pick = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    ties = lambda v, n: placed.groupBy(*keys, *v).agg(F.sum("c").alias("t")).groupBy(*keys).agg(pick("t").alias(n))
    total = placed.groupBy(*keys).agg(F.max("n").alias("n"), pick("c").alias("txy"))
    for part in (wrong, ties(["x"], "tx"), ties(["y"], "ty")):
        cols = [c for c in part.columns if c not in keys]
        part = part.select(*(F.col(k).alias(a) for k, a in zip(keys, names)), *cols)
        total = total.join(part, _same(keys, names)).drop(*names)
    all_ = F.col("n").cast("double") * (F.col("n") - 1) / 2
    spread = F.sqrt(all_ - F.col("tx")) * F.sqrt(all_ - F.col("ty"))
    return total.select(*keys, ((all_ - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("d")) / F.nullif(spread, F.lit(0.0))).alias("kendall"))
