"""All queries of the library and their SQL."""

from __future__ import annotations

from . import agreement_queries, audit_queries, geometry_queries, model_queries, paired_queries, relational_queries, ridge_queries, source_queries, timeseries_queries

MODULES = [agreement_queries, relational_queries, timeseries_queries, geometry_queries, model_queries, audit_queries, ridge_queries, source_queries, paired_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
