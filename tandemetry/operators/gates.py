"""Gates: named conditions over a table that can stop a run: by an aggregation of their own, or observed in the job that
writes the table, which costs no further pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.tables import written


def checks(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(gate, passed); each condition is a boolean aggregate, a null counts as failed."""
    row = df.agg(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in conditions.items()))
    return row.unpivot([], list(conditions), "gate", "passed")


def enforce(passed: DataFrame) -> None:
    bad = sorted(r.gate for r in passed.filter(~F.col("passed")).collect())
    if bad:
        raise AssertionError("gates failed: " + ", ".join(bad))


def guarded(df: DataFrame, name: str, conditions: dict[str, Column]) -> DataFrame:
    """df written to the shared folder and reread, the conditions observed in the same job. Where one fails, nobody learns the
    table's path. conditions: boolean aggregates without DISTINCT; a null counts as failed."""
    seen = Observation(name)
    out = written(df.observe(seen, *(F.coalesce(c, F.lit(False)).alias(n) for n, c in conditions.items())), name)
    bad = sorted(n for n, passed in seen.get.items() if not passed)
    if bad:
        raise AssertionError("gates failed: " + ", ".join(bad))
    return out
