"""The network against a plain convolution and numeric derivatives, held-out accuracy, awkward tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemetry.llm import quality_cnn as Q
from tandemetry.llm.queries import op13_quality_classifier

from .helpers import awkward, clashing, empty

SF = "/root/testdata/sf0.01"


def net():
    n = Q.Net.fresh(np.random.default_rng(1))
    n.weights = np.random.default_rng(2).normal(size=2 * Q.FILTERS).astype(np.float32)
    n.offset = 0.25
    return n


def plain_pooled(n, text):
    """Window by window, chunk by chunk."""
    if not text:
        return np.zeros(2 * Q.FILTERS)
    count = max(0, -(-(len(text) - 8) // 2)) + 1
    text = text.ljust((count - 1) * 2 + 8, b" ")
    out = []
    for i in range(count):
        bits = [1 if byte >> (7 - b) & 1 else -1 for byte in text[2 * i : 2 * i + 8] for b in range(8)]
        out.append(np.maximum(0, np.array(bits) @ n.filters + n.bias))
    chunks = [np.max(out[a : a + 256], 0) for a in range(0, max(1, -(-count // 128) * 128 - 128), 128)]
    return np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)])


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 10, 255, 262, 263, 264, 519, 520, 16390, 16391, 16392, 16393, 40000])
def test_whole_texts(size):
    text = np.random.default_rng(size).integers(0, 256, size, np.uint8).tobytes()
    n = net()
    assert n.pooled(text) == pytest.approx(plain_pooled(n, text), abs=1e-4)


def test_a_change_anywhere_counts():
    n, text = net(), b"abc " * 20_000
    changed = text[:60_001] + bytes([255] * 8) + text[60_009:]
    assert not np.array_equal(n.pooled(text), n.pooled(changed))


def test_derivatives():
    n = net()
    text = np.random.default_rng(4).integers(32, 127, 1500, np.uint8)
    loss, found = n.gradients(text, 1)
    assert loss == pytest.approx(-np.log(n.score(text.tobytes())), abs=1e-4)
    rng = np.random.default_rng(9)
    for name in ("filters", "bias", "weights"):
        value = getattr(n, name)
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in value.shape)
            kept, ends = value[at], []
            for step in (1e-3, -1e-3):
                value[at] = kept + step
                ends.append(n.gradients(text, 1)[0])
            value[at] = kept
            assert found[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-3, abs=5e-3)


def test_held_out_accuracy(spark):
    got = op13_quality_classifier(spark, SF)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, y in held if y == c] for c in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([(s >= 0.7) == y for s, y in held]) > 0.95
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]


def test_labels_of_held_out_rows_are_never_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    assert Q.sample(docs, labels) == Q.sample(docs, turned)


def test_the_sample_is_bounded(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.when(F.col("id") < 50, F.repeat(F.lit("x"), 99)).otherwise("")).alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("int").alias("quality"))
    texts, y, w = Q.sample(docs.unionByName(docs), labels.unionByName(labels), rows=20, most=50)
    assert 0 < sum(y) <= 20 and 0 < len(y) - sum(y) <= 20 and max(map(len, texts)) <= 50
    known = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sum(v for v, c in zip(w, y) if c) == pytest.approx(sum(i % 5 == 0 for i in known))


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0), (4, 0, 0), (6, 1, 0), (None, 1, 0), (7, None, 0), (8, 0, 1), (9, 2, 0)], "doc_id long, quality int, toxic int")
    few = awkward(spark)
    got = Q.classify(few, labels).collect()
    assert len(got) == few.count() and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].score == by_id[3].score and not by_id[None].held_out
    again = Q.classify(clashing(few), labels).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert Q.classify(empty(spark), labels).collect() == []
    assert {r.score for r in Q.classify(few, labels.limit(0)).collect()} == {0.5}
    assert all(r.score > 0.99 for r in Q.classify(few, labels.filter("quality = 1 and doc_id = 1")).collect())
