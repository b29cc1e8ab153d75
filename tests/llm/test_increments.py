"""Large increments of the ledger, long lists of matches, placement in shards, a table of suffixes: against plain versions."""

import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tandemetry.llm import queries, secret_scan, sharding, url_filter
from tandemetry.sources.tables import fresh

from .helpers import awkward
from .test_llm import plain_secrets

SF = "/root/testdata/sf0.001"


def spans_as_text(found):
    return {r.doc_id: r.base for r in found.select("doc_id", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",").alias("base")).collect()}


def test_matches_over_several_blocks(spark):
    """Around a block's length, and many blocks; short matches, which are dropped but use their characters, fall anywhere."""
    texts = ["".join(f"x token={'ab' if i % 7 == 3 else f'secret{i}'} " for i in range(n)) for n in (1, 127, 128, 129, 256, 257, 5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert spans_as_text(secret_scan.scan(docs)) == {i: plain_secrets(t) for i, t in enumerate(texts)}


def test_large_increment_moves_unseen_texts_only(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "FEW_BLOBS", 0)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("password=secret"), F.col("id") % 3000).alias("text"))
    ledger, first = fresh(spark, "ledger"), docs.filter("doc_id % 3000 >= 40")
    secret_scan.scan(first, ledger_path=ledger)
    moved = []
    maybe = secret_scan._maybe

    def counted(rows, todo, n):
        out = maybe(rows, todo, n)
        wanted, kept = {r.blob for r in todo.collect()}, [r.blob for r in out.collect()]
        assert n == len(wanted) == 40 and wanted <= set(kept)
        assert "Exchange hashpartitioning(blob" not in out._jdf.queryExecution().toString()
        moved.append(len(kept))
        return out

    monkeypatch.setattr(secret_scan, "_maybe", counted)
    got = spans_as_text(secret_scan.scan(docs, ledger_path=ledger))
    assert got == {r.doc_id: plain_secrets(r.text) for r in docs.collect()}
    assert 80 <= moved[0] < 80 + 4000 / 100  # 1,280 of 32,768 bits at most are set for 40 blobs, so some others pass
    assert spark.read.parquet(ledger).count() == 3000  # nothing was scanned twice


def test_large_increment_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "FEW_BLOBS", 0)
    docs, ledger = awkward(spark), fresh(spark, "ledger")
    secret_scan.scan(docs.limit(4), ledger_path=ledger)
    got = Counter((r.doc_id, str(r.spans)) for r in secret_scan.scan(docs, ledger_path=ledger).collect())
    assert got == Counter((r.doc_id, str(r.spans)) for r in secret_scan.scan(docs).collect())


def plain_shard(key, shards):
    """Rendezvous: the largest signed XXH64 of seed, shard and key, each hashed with the hash before as its seed."""

    def weight(s):
        h = 42
        for part in (struct.pack("<i", sharding.SEED), struct.pack("<i", s), *([] if key is None else [struct.pack("<q", key)])):
            h = xxhash.xxh64_intdigest(part, h)
        return h - (1 << 64) * (h >> 63)

    return max((weight(s), s) for s in range(shards))[1]


def test_placement_in_shards_by_plain_hashes(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_sharding(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]))
        assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, sharding.SHARDS), plain_shard(r.doc_id, sharding.SHARDS + 1))
    slots = Counter((r.shard, r.slot) for r in rows)
    sizes = Counter(r.shard for r in rows)
    assert set(slots) == {(s, i) for s, n in sizes.items() for i in range(n)} and max(slots.values()) == 1
    null = spark.createDataFrame([(None,)], "k long").select(sharding.shard_of(F.col("k"), 40).alias("s")).first().s
    assert null == plain_shard(None, 40)


def test_suffixes_from_a_table(spark):
    hosts = ["a.b.city.kawasaki.jp", "x.y.kawasaki.jp", "p.q.co.uk", "co.uk", "u@h.example.com:80", "1.2.3.4", "localhost", "", "n.ck.", "kawasaki.jp"]
    table = spark.createDataFrame([("kawasaki.jp",), ("city.kawasaki.jp",), ("co.uk",), ("co.uk",), (None,), ("ck",)], "suffix string")
    frame = spark.createDataFrame([(h, 2, 1) for h in hosts], "host string, n long, k long")
    got = {r.host: (r.suffix, r.domain) for r in url_filter.placed(frame, table).collect()}
    assert got == {
        "a.b.city.kawasaki.jp": ("city.kawasaki.jp", "b.city.kawasaki.jp"), "x.y.kawasaki.jp": ("kawasaki.jp", "y.kawasaki.jp"), "p.q.co.uk": ("co.uk", "q.co.uk"),
        "co.uk": ("co.uk", "co.uk"), "u@h.example.com:80": ("com", "example.com"), "1.2.3.4": ("", "1.2.3.4"), "localhost": ("localhost", "localhost"), "": ("", ""),
        "n.ck.": ("ck", "n.ck"), "kawasaki.jp": ("kawasaki.jp", "kawasaki.jp"),
    }
    same = spark.createDataFrame([(s,) for s in url_filter.TWO_LABEL_SUFFIXES], "suffix string")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    outcomes = spark.read.parquet(f"{SF}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))
    plain, by_table = (Counter(map(str, url_filter.filter_urls(pages, outcomes, queries.URL_RULES, suffixes=t).collect())) for t in (None, same))
    assert plain == by_table and len(plain)
