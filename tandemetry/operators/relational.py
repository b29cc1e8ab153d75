"""Relational glue: guarded lookups, set pairing, exclusion by rank, summaries over several groupings, keys in strings."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def key_parts(c: Column, pattern: str, names: list[str]) -> Column:
    """A composite key's fields as a struct of strings; all null unless the whole string fits."""
    whole = c.rlike(f"^(?:{pattern})$")
    return F.struct(*(F.when(whole, F.regexp_extract(c, f"^(?:{pattern})$", i + 1)).alias(n) for i, n in enumerate(names)))


def require(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """df, failing at run time on a row where ``bad`` holds."""
    return df.filter(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def exclude_top(rows: DataFrame, id_col: str, by: str, share: float) -> DataFrame:
    """rows without the ceil(n * share) largest by ``by`` (ties by the smaller id; nulls stay). The rows' (by, id) are dealt
    out by range and written; the sizes of the ranges say in which one the last excluded row lies, and only that one is
    sorted to its place. So no task sees more than one range."""
    n = rows.count()
    k = ceil(n * share)
    if not k:
        return rows
    keys = rows.select(F.col(by).alias("v"), F.col(id_col).alias("i")).filter(F.col("v").isNotNull())
    dealt = written(keys.repartitionByRange(F.desc("v"), F.asc("i")).select("v", "i", F.spark_partition_id().alias("part")), "ranges")
    before, place, last = 0, None, None
    for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # one row per range
        if before + r.n >= k:
            place = r.part
            break
        before += r.n
    if place is None:
        return rows.filter(F.col(by).isNull())
    order = Window.partitionBy("part").orderBy(F.desc("v"), F.asc("i"))
    last = dealt.filter(F.col("part") == place).withColumn("k", F.row_number().over(order)).filter(F.col("k") == k - before).first()
    top = (F.col(by) > last.v) | ((F.col(by) == last.v) & (F.col(id_col) <= last.i))
    return rows.filter(~top | F.col(by).isNull())


def grouping_summary(df: DataFrame, groupings: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """One pass over several groupings, as GROUPING SETS; level numbers the grouping."""
    keys = sorted({k for g in groupings for k in g})
    sets = [[F.col(k) for k in g] for g in groupings]
    level = F.lit(None).cast("int")
    for i, g in enumerate(groupings):
        missing = F.lit(0)
        for j, k in enumerate(keys):
            missing = missing + (0 if k in g else 1 << (len(keys) - 1 - j))
        level = F.when(F.grouping_id() == missing, i).otherwise(level)
    return df.groupingSets(sets, *[F.col(k) for k in keys]).agg(level.alias("level"), *aggregates)


def aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> int:
    """How many keys stand on one side only."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.exceptAll(right).count() + right.exceptAll(left).count()


def ranked(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """df with rank_<value> for each value, ties sharing their mean rank. Equal values are counted first, in each task and
    then together, so the running sums go over distinct values only; ranks come back by a join on the value. df is written
    first: were it made anew for each side, a mean's last bits could differ between the two, and rows would find no rank."""
    df = written(df, "ranked")
    for v in values:
        counts = df.groupBy(*keys, v).agg(F.count(F.lit(1)).alias("_c"))
        w = Window.partitionBy(*keys).orderBy(v).rowsBetween(Window.unboundedPreceding, -1)
        ranks = counts.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col(v).alias("_v"), (F.coalesce(F.sum("_c").over(w), F.lit(0)) + (F.col("_c") + 1) / 2.0).alias(f"rank_{v}"))
        on = F.col(v).eqNullSafe(F.col("_v"))
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        df = df.join(ranks, on).drop("_v", *(f"_k_{k}" for k in keys))
    return df
