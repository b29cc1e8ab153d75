"""Tables of a row per sensor or cell are broadcast: rows never gather by so few keys."""

from tandemetry.plans import ridge_queries as Q
from tandemetry.sources import tables

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_meet_their_scale_by_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(Q.rows(spark, SF))
        assert "SortMergeJoin [sensor" not in plan and "BroadcastHashJoin [sensor" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_meet_their_cell_by_broadcast(spark, monkeypatch):
    seen, write = [], tables.written
    from tandemetry.operators import subsampling

    monkeypatch.setattr(subsampling, "written", lambda df, name: (seen.append(_plan(df)), write(df, name))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        Q.split(Q.rows(spark, SF), 2, ["quantity"])
        assert len(seen) == 1 and "BroadcastHashJoin [sensor" in seen[0]  # rows with cells; cells among themselves may merge
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
