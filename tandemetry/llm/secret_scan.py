"""Secret scans with an incremental blob ledger, with DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The addresses alone, without texts, meet the
ledger: only (blob, rule version) pairs that it lacks are scanned. Their texts are fetched once per blob; where nothing is
new, no text is moved at all. A short list of unseen blobs is sent to the texts, a long one as a bitmap of hashed addresses
of a bounded size: rows that it rules out stay where they are, and the exact list decides on the others. The findings are joined back to all paths that hold the blob. A group of copies is one blob:
map-side aggregation already folds it. A run that dies before the append has recorded nothing, one that dies after it
finds its pairs done.

A rule's matches are leftmost and non-overlapping. Their places come from the regular expression's matches and the gaps
between them: a match starts where the lengths before it end, added up in blocks. Offsets are in code points, the end exclusive.

Defined results: a null text is the empty text; a null id stays null; repeated rows give the same findings each; extra
columns are ignored; empty tables give empty tables. Of rules that share a start, the one listed first comes first.
A text lies whole in one task, so the longest text bounds its memory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import fresh
from .common import let, materialize

BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class SecretRule:
    """min_length: of group ``group`` of a match, else the match is dropped. A changed rule needs a new version."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds' patterns are fixed values. Runs of a class that are too short can't be part of a longer match, so for
#: access and hex the least length stands in the pattern; for assign a short match still uses up its characters.
RULES = (
    SecretRule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, min_length=6),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}"),
    SecretRule("hex", r"[0-9a-f]{24,}"),
    SecretRule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    SecretRule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Matches in a block: an array grows by copying, so a long list is a list of blocks until its end.
BLOCK = 128


def spans_of(text: Column, rule: SecretRule, rank: int) -> Column:
    """One rule's spans in a text. A text without a match costs one pass."""

    def placed(found: Column) -> Column:
        gaps, whole, part = found["gaps"], found["whole"], found["part"]
        count = F.size(whole)
        none = F.array().cast(SPAN)

        def step(acc: Column, i: Column) -> Column:
            begin = acc["at"] + F.get(gaps, i)
            end = begin + F.get(whole, i)
            span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            good = F.when(F.get(part, i) >= rule.min_length, F.array(span)).otherwise(none)
            return F.struct(end.alias("at"), F.concat(acc["spans"], good).alias("spans"))

        def block(acc: Column, first: Column) -> Column:
            inside = F.sequence(first, F.least(first + BLOCK, count) - 1)
            done = F.aggregate(inside, F.struct(acc["at"].alias("at"), none.alias("spans")), step)
            return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["blocks"], F.array(d["spans"])).alias("blocks")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("blocks"))
        return F.aggregate(F.sequence(F.lit(0), count - 1, F.lit(BLOCK)), start, block, lambda acc: F.flatten(acc["blocks"]))

    pattern = F.lit(rule.pattern)
    lengths = lambda c: F.transform(c, F.length)
    found = F.struct(
        lengths(F.split(text, rule.pattern)).alias("gaps"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("whole"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("part"),
    )
    return F.when(text.rlike(rule.pattern), let(found, placed)).otherwise(F.array().cast(SPAN))


#: Unseen blobs up to which their list is sent to the texts (some 150 bytes each); beyond it a bitmap of their hashes is.
FEW_BLOBS = 100_000
#: Bits of the bitmap for each unseen blob, and at most (64 MB); a part of it, as Spark's bitmap functions make it, has PART.
BLOB_BITS, MOST_BITS, PART = 16, 1 << 29, 1 << 15


def unseen(blobs: DataFrame, rules: tuple[SecretRule, ...], ledger: DataFrame | None) -> DataFrame:
    """(blob, todo: rule keys) of the blobs with pairs that the ledger lacks. blobs: one column, repeats allowed."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    distinct = blobs.select("blob").distinct()
    if ledger is None:
        return distinct.withColumn("todo", keys)
    seen = ledger.select("blob", F.explode("scanned").alias("key")).groupBy("blob").agg(F.collect_set("key").alias("seen"))
    todo = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
    return distinct.join(seen, "blob", "left").select("blob", todo.alias("todo")).filter(F.size("todo") > 0)


def scan_blobs(blobs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, scanned: rule keys, spans) for blobs: (blob, todo, text), one row each."""
    none = F.array().cast(SPAN)
    new = [F.when(F.array_contains("todo", r.key), spans_of(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    return blobs.select("blob", F.col("todo").alias("scanned"), F.concat(*new).alias("spans"))


def _maybe(rows: DataFrame, todo: DataFrame, n: int) -> DataFrame:
    """The rows whose blob's bit is set by some of the n blobs of todo, all rows of these among them; rows aren't moved."""
    bits = min(max(PART, 1 << (n * BLOB_BITS - 1).bit_length()), MOST_BITS)
    place = F.pmod(F.xxhash64("blob"), F.lit(bits))
    part, bit = F.floor(place / PART), F.pmod(place, F.lit(PART))
    parts = todo.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(bit).alias("bitmap"))
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1
    return rows.join(F.broadcast(parts), (part == F.col("part")) & is_set).select("blob", "text")


def _texts(rows: DataFrame, todo: DataFrame, first_run: bool) -> DataFrame:
    """(blob, todo, text), one row for each blob of todo. rows: (blob, text). In a first run every row is wanted."""
    n = todo.count()
    if n <= FEW_BLOBS:
        return rows.join(F.broadcast(todo), "blob").groupBy("blob").agg(F.first("todo").alias("todo"), F.first("text").alias("text"))
    wanted = rows if first_run else _maybe(rows, todo, n)
    return wanted.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[SecretRule, ...] = RULES, ledger_path: str | None = None) -> DataFrame:
    """doc_id, blob, spans (sorted by start, then rule order) for each row of docs. With a ledger path, what was scanned
    before is read from there and what is new is appended, clean blobs included."""
    spark: SparkSession = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    paths = materialize(rows.select("doc_id", "blob"), "paths")
    path = ledger_path or fresh(spark, "ledger")
    try:
        ledger = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        ledger = None
    todo = materialize(unseen(paths, rules, ledger), "unseen")
    if ledger is None or not todo.isEmpty():
        scan_blobs(_texts(rows.select("blob", "text"), todo, ledger is None), rules).write.mode("append").parquet(path)
    return paths.join(findings(spark.read.parquet(path), rules), "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def findings(ledger: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """(blob, spans) of the blobs with findings by these rules' versions; those of other versions give way. A written table, so
    that the join back to paths can be split where a blob is hot."""
    current = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    keys = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.key))])
    spans = ledger.filter(F.size("spans") > 0).select("blob", "scanned", F.explode("spans").alias("s")).filter(F.array_contains("scanned", keys[F.col("s.kind")]))
    span = F.struct(F.col("s.start").alias("start"), current[F.col("s.kind")].alias("rank"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind"))
    return materialize(spans.groupBy("blob").agg(F.sort_array(F.collect_set(span)).alias("spans")), "secrets")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
