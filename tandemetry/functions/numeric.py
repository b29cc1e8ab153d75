"""Small column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column | str) -> Column:
    """Rounded to six digits, without a negative zero: what reports show."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def present(c: Column | str) -> Column:
    """Missing values are nulls: a NaN or an infinity becomes one, so aggregates skip it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def over(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (ANSI mode would raise)."""
    return F.when(b != 0, a / b)


def band(c: Column | str, edges: tuple[float, ...]) -> Column:
    """Number of the band, right-closed: v <= edges[0] is 0, v <= edges[1] is 1, ..."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(c <= F.lit(edges[i]), i).otherwise(out)
    return F.when(c.isNotNull(), out)


def quality_bucket(c: Column | str) -> Column:
    """A correlation as poor, weak, moderate or good; a missing one counts as good, as no comparison holds."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c < 0.2, "poor").when(c < 0.3, "weak").when(c < 0.5, "moderate").otherwise("good")
