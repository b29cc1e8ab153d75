"""Resampling by weights on sufficient statistics: a replicate is a join with a small weight table, never a copy of the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .agreement import from_moments

ADDITIVE = ("n", "sx", "sy", "sxx", "syy", "sxy", "sabs", "sdd")


def cluster_sums(pairs: DataFrame, keys: list[str], cluster: str, x: str = "x", y: str = "y") -> DataFrame:
    """Additive sums per cluster, of values centred on their group's means so that nothing cancels."""
    a, b = F.col(x), F.col(y)
    means = pairs.groupBy(*keys).agg(F.avg(a).alias("cx"), F.avg(b).alias("cy"))
    p = pairs.join(means, keys)
    u, v = a - F.col("cx"), b - F.col("cy")
    return p.groupBy(*keys, cluster, "cx", "cy").agg(
        F.count(F.lit(1)).alias("n"), F.sum(u).alias("sx"), F.sum(v).alias("sy"), F.sum(u * u).alias("sxx"), F.sum(v * v).alias("syy"),
        F.sum(u * v).alias("sxy"), F.sum(F.abs(b - a)).alias("sabs"), F.sum((b - a) * (b - a)).alias("sdd"),
    )


def drawn_weights(clusters: DataFrame, cluster: str, reps: int, draw: Column) -> DataFrame:
    """(rep, cluster, w): how often each cluster is drawn. draw: an integer in terms of rep and slot, taken modulo the
    number of clusters; cluster numbers follow their order."""
    ordered = clusters.select(cluster).distinct()
    numbered = ordered.agg(F.sort_array(F.collect_list(cluster)).alias("all"))  # one row: clusters are participants
    # replicates are dealt out before they are drawn: from one row they would all be made in one task
    slots = numbered.select("all", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    slots = slots.repartition("rep").select("all", "rep", F.explode(F.sequence(F.lit(0), F.size("all") - 1)).alias("slot"))
    picked = slots.select("rep", F.get("all", F.pmod(draw, F.size("all")).cast("int")).alias(cluster))
    return picked.groupBy("rep", cluster).agg(F.count(F.lit(1)).alias("w"))


def numpy_weights(spark: SparkSession, clusters: list, cluster: str, reps: int, seed: int) -> DataFrame:
    """The same from NumPy's generator, for parity with seeded studies; reps times the number of clusters rows."""
    import pandas as pd

    names = sorted(clusters)
    draws = np.random.default_rng(seed).integers(0, len(names), (reps, len(names)))
    rows = [(r, names[c], int(n)) for r, d in enumerate(draws) for c, n in enumerate(np.bincount(d, minlength=len(names))) if n]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["rep", cluster, "w"]))


def replicated(sums: DataFrame, weights: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """Agreement metrics per replicate: weighted sums, then the closed forms."""
    j = sums.join(weights, cluster).groupBy(*keys, "rep", "cx", "cy").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in ADDITIVE))
    n = F.col("n")
    spread = lambda a, b, ab: F.when(n > 1, (F.col(ab) - F.col(a) * F.col(b) / n) / (n - 1))
    m = j.select(
        *keys, "rep", n.cast("long").alias("n"), (F.col("cx") + F.col("sx") / n).alias("mx"), (F.col("cy") + F.col("sy") / n).alias("my"),
        spread("sx", "sx", "sxx").alias("vx"), spread("sy", "sy", "syy").alias("vy"), spread("sx", "sy", "sxy").alias("cxy"),
        (F.col("sabs") / n).alias("mae"), (F.col("sdd") / n).alias("mse"),
    )
    return from_moments(m, [*keys, "rep"])


def percentile_ci(reps: DataFrame, keys: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """2.5 and 97.5 percentiles by linear interpolation."""
    out = []
    for m in metrics:
        out += [F.expr(f"percentile({m}, 0.025)").alias(f"{m}_low"), F.expr(f"percentile({m}, 0.975)").alias(f"{m}_high")]
    return reps.groupBy(*keys).agg(*out)


def sample_without_replacement(rows: DataFrame, groups: list[str], order: list, take: Column) -> DataFrame:
    """The first ``take`` rows of each group in a drawn order; take may use n, the group's size. Groups are small cells."""
    w = Window.partitionBy(*groups)
    ranked = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("place", F.row_number().over(w.orderBy(*order)).cast("long"))
    return ranked.filter(F.col("place") <= take)
