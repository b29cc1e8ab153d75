"""Ranks of values that don't come out the same twice, as means over many tasks don't to the last bit."""

import random

from pyspark.sql import functions as F

from tandemetry.operators.relational import ranked


def test_rows_made_anew_keep_their_ranks(spark):
    drawn = F.udf(lambda: random.random(), "double").asNondeterministic()
    rows = spark.range(200, numPartitions=3).withColumn("k", F.col("id") % 2).withColumn("v", drawn()).withColumn("w", drawn())
    found = ranked(rows, ["k"], ["v", "w"]).collect()
    assert len(found) == 200
    for k in (0, 1):
        for c in ("v", "w"):
            some = sorted((r[c], r[f"rank_{c}"]) for r in found if r.k == k)
            assert [rank for _, rank in some] == list(range(1, 101))
