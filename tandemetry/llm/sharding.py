"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters records by seeded hashes: the shard is the one whose hash with the id is largest (so it depends on the
id and the number of shards alone, and one more shard takes records only into itself), the bucket within the shard is a
uniform hash of the record. A shard has as many buckets as its bytes ask for, so that each fits in memory however uneven
the shards are. Pass two shuffles each bucket with Fisher-Yates (Spark's seeded ``shuffle``), lays the buckets of a shard
end to end and writes them: a record's slot is the number of records in the buckets before plus its place in its own.

The draw is the same on every run, whatever the number of shuffle partitions: a bucket's records are put in the order of
their hashes first, and buckets are dealt out to a number of partitions that the data alone decide, in order, as the
generator is seeded per partition. So a lost task draws again what it had drawn.

Equal rows have one hash and would share a bucket. They are found in a narrow table of hashes, folded into one row with a
count by map-side aggregation, and unfolded with a copy number that enters the bucket's hash. Other rows move once.

Defined results: a null text has size 16 and is written as null; all null ids share a shard; repeated rows get slots of
their own; extra columns are kept, and where one is named shard or slot, ours is shard_ or slot_; an empty table gives no
rows and a folder that can be read. Columns must be of types that can be hashed and ordered (no maps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 40
SEED = 1234
#: Bytes of a bucket on average; buckets that a task draws one after the other.
BUCKET_BYTES, BUCKETS_PER_TASK = 32 << 20, 4
#: Copies that are unfolded at once.
CHUNK = 4096


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the largest hash of key and shard; ties go to the higher number."""
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), s, key).alias("h"), s.alias("s"))))
    return best["s"]


def size_of(text: Column) -> Column:
    """UTF-8 bytes and 16 more."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 16).cast("long")


def _unfolded(rows: DataFrame) -> DataFrame:
    """Each row as often as its column copies says, numbered from 1 in column copy; in chunks, so that no array is long."""
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK))))
    last = F.least(F.col("copies"), (F.col("chunk") + 1) * CHUNK)
    return chunks.withColumn("copy", F.explode(F.sequence(F.col("chunk") * CHUNK + 1, last))).drop("chunk", "copies")


def free_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of docs, whole, with shard and slot (shard_, slot_ where these are taken)."""
    whole = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("r"), F.xxhash64(F.lit(seed), *[docs[c] for c in docs.columns]).alias("h"),
        shard_of(docs[id_col], shards, seed).alias("shard"), size_of(docs[text_col]).alias("size"),
    )
    keys = materialize(whole.groupBy("shard", "h", "size").agg(F.count(F.lit(1)).alias("copies")), "shard-keys")
    sizes = keys.groupBy("shard").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes")).collect()  # a row per shard
    buckets = {r.shard: r.bytes // bucket_bytes + 1 for r in sizes} or {0: 1}
    of_shard = F.create_map(*[F.lit(x) for pair in buckets.items() for x in pair])
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), "h", "copy"), of_shard[F.col("shard")])

    repeated = keys.filter("copies > 1").select("h")
    rows = whole.select("r", "h", "shard")
    records = rows.withColumn("copy", F.lit(1).cast("long"))
    if not repeated.isEmpty():
        folded = rows.join(repeated, "h", "left_semi").groupBy("r", "h", "shard").agg(F.count(F.lit(1)).alias("copies"))
        records = records.join(repeated, "h", "left_anti").unionByName(_unfolded(folded))

    counts = _unfolded(keys).groupBy("shard", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    tasks = sum(buckets.values()) // BUCKETS_PER_TASK + 1
    scattered = records.select("shard", bucket.alias("bucket"), F.struct("h", "copy", "r").alias("record")).repartition(tasks, "shard", "bucket")
    gathered = scattered.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list("record")).alias("records")).sortWithinPartitions("shard", "bucket")
    drawn = gathered.select("shard", "bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("place", "record"))
    slot = (F.col("offset") + F.col("place")).alias(free_name(docs, "slot"))
    return drawn.join(F.broadcast(offsets) if len(buckets) * max(buckets.values()) <= 100_000 else offsets, ["shard", "bucket"]).select("record.r.*", slot, F.col("shard").alias(free_name(docs, "shard")))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``assign``, written as Parquet folders shard=0, shard=1, ..., each in the order of slots within a file, and read back."""
    placed = assign(docs, id_col, text_col, shards, seed, bucket_bytes)
    slot, shard = placed.columns[-2:]
    placed.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    spark = docs.sparkSession
    schema = placed.schema
    if not spark.read.schema(schema).parquet(path).head(1):  # an empty table leaves a file, so that the folder has a schema
        placed.drop(shard).limit(0).coalesce(1).write.mode("append").parquet(f"{path}/{shard}=0")
    return spark.read.schema(schema).parquet(path)
