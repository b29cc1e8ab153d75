"""A Merkle manifest of a table: one root hash, and for every row the proof that it belongs to it.

Rows are leaves of one tree per group (a language), the groups' roots are leaves of a tree on top; eight consecutive nodes
become one. A tree is built as a nested-struct rollup: nodes are ranked, a block is 8^4 consecutive ones, and the digits of
the rank within its block are grouped away one after the other, each time nesting the children's structs in their parent's.
The four groupings share one exchange by block, as its key is part of theirs. The blocks' hashes are the nodes of the next
stage, until a group is one node. Proofs come the other way: a stage's blocks are taken apart by transform and explode,
each level adding the siblings' hashes to the path; a block's own path, from the stage above, meets it in a grouping by
block. No leaf is ever joined to its siblings, and no row holds more than a block.

Ranks are found by ranges of (group, order, hash): running sums within a range, offsets from one small row per range and
group, so that a group of any size is spread over many tasks. Rows equal in all that is hashed are folded into one with a
count before, and unfolded inside their blocks.

Defined results: a null is hashed as ``-``; null groups and null ids come first; rows with one id are ordered by their
leaves' hashes, and equal rows are leaves of their own; a lone leaf is its group's root; an empty table gives no rows.
Extra columns are left out of the hashes and of the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: Children of a node; digits of a block.
FAN, DIGITS = 8, 4
BLOCK = FAN**DIGITS
_PATH = "array<struct<before: string, after: string>>"


def field(c: Column) -> Column:
    """A value as it is hashed: its UTF-8 bytes' number, a colon and itself; a dash for a null."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings laid end to end."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(rows: DataFrame, fields: list[str], group: str, order: str, tampered: dict[str, Column]) -> DataFrame:
    """(g, o, leaf, found, copies): a leaf's hash, and that of the row as it is found, with ``tampered`` in place of columns."""
    hashed = rows.select(
        F.col(group).alias("g"), F.col(order).alias("o"), digest(*(field(F.col(f)) for f in fields)).alias("leaf"),
        digest(*(field(tampered.get(f, F.col(f))) for f in fields)).alias("found"),
    )
    return hashed.groupBy("g", "o", "leaf", "found").agg(F.count(F.lit(1)).alias("copies"))


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows (with a column copies) and first, the rank from 0 of a row's first copy in its group, and n, the group's size."""
    dealt = rows.repartitionByRange(*(F.asc_nulls_first(c) for c in [*group, *order]))
    dealt = materialize(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*group, "range").agg(F.sum("copies").alias("inside"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "range", F.coalesce(F.sum("inside").over(earlier), F.lit(0)).alias("offset"), F.sum("inside").over(whole).alias("n"))
    # one row of offsets per range and group comes first in the range's own window, so nothing is joined
    both = dealt.withColumn("side", F.lit(1)).unionByName(offsets.withColumn("side", F.lit(0)), allowMissingColumns=True)
    span = Window.partitionBy(*group, "range").orderBy("side", *(F.asc_nulls_first(c) for c in order))
    before = span.rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("offset").over(span) + F.coalesce(F.sum("copies").over(before), F.lit(0))
    numbered = both.select(*rows.columns, "side", first.alias("first"), F.first("n").over(span).alias("n"))
    return numbered.filter("side = 1").drop("side")


def _applies(level: Column | int) -> Column:
    """Whether a group of n leaves has more than one node under ``level`` (1 is the leaves' parents)."""
    return F.col("n") > F.pow(F.lit(float(FAN)), F.lit(level) - 1)


def rollup(nodes: DataFrame, keys: list[str], below: int, payload: list[str]) -> DataFrame:
    """(keys, block, n, hash, children): blocks of nodes (keys, block, at, hash, n, payload) nested level by level. below: the
    levels under these nodes. Where a group is one node already, its hash passes through. nodes are dealt out by keys and block."""
    digits = [F.floor(F.col("at") / FAN**i) % FAN for i in range(DIGITS)]
    node, inner = nodes.select(*keys, "n", "block", *(d.cast("int").alias(f"d{i}") for i, d in enumerate(digits)), "hash", *payload), payload
    for i in range(DIGITS):
        child = F.struct(F.col(f"d{i}").alias("d"), "hash", *inner)
        rest = [f"d{j}" for j in range(i + 1, DIGITS)]
        node = node.groupBy(*keys, "n", "block", *rest).agg(F.sort_array(F.collect_list(child)).alias("children"))
        joined = F.sha2(F.array_join(F.transform("children", lambda c: c["hash"]), "").cast("binary"), 256)
        node = node.withColumn("hash", F.when(_applies(below + i + 1), joined).otherwise(F.col("children")[0]["hash"]))
        inner = ["children"]
    return node.select(*keys, "block", "n", "hash", "children")


@dataclass
class Stage:
    """A written stage of blocks and the number of levels under its nodes."""

    blocks: DataFrame
    below: int


def _dealt(nodes: DataFrame, keys: list[str]) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / BLOCK)).repartition(*keys, "block")


def _stages(nodes: DataFrame, keys: list[str], payload: list[str], longest: int) -> list[Stage]:
    """Stages from the leaves up, until every group of at most ``longest`` leaves is one node."""
    out, below = [], 0
    while True:
        out.append(Stage(materialize(rollup(nodes, keys, below, payload if not out else []), "merkle-stage"), below))
        below += DIGITS
        if longest <= FAN**below:
            return out
        nodes = _dealt(out[-1].blocks.select(*keys, F.col("block").alias("at"), "hash", "n"), keys)


def _descend(stage: Stage, keys: list[str], paths: DataFrame, payload: list[str]) -> DataFrame:
    """(keys, at, path, hash, payload): a stage's nodes with the siblings from themselves up to the root. paths: (keys,
    block, path) of its blocks."""
    blocks = stage.blocks.withColumn("path", F.lit(None).cast(_PATH)).unionByName(paths, allowMissingColumns=True)
    whole = [F.first(c, ignorenulls=True).alias(c) for c in ("n", "children", "path")]
    level = blocks.groupBy(*keys, "block").agg(*whole).withColumn("at", F.col("block"))
    for i in range(DIGITS, 0, -1):
        side = lambda test: F.array_join(F.transform(F.filter("children", test), lambda s: s["hash"]), "")
        kids = F.transform("children", lambda c: F.struct(c.alias("c"), side(lambda s: s["d"] < c["d"]).alias("before"), side(lambda s: s["d"] > c["d"]).alias("after")))
        level = level.select(*keys, "n", "at", "path", F.explode(kids).alias("k"))
        step = F.array(F.struct("k.before", "k.after"))
        path = F.when(_applies(stage.below + i), F.concat(step, "path")).otherwise(F.col("path"))
        more = ["k.c.children"] if i > 1 else ["k.c.hash", *(f"k.c.{p}" for p in payload)]
        level = level.select(*keys, "n", (F.col("at") * FAN + F.col("k.c.d")).alias("at"), path.alias("path"), *more)
    return level


def _climb(start: Column, path: Column) -> Column:
    """The root that a leaf's hash and its siblings give."""
    return F.aggregate(path, start, lambda h, p: digest(p["before"], h, p["after"]))


def proofs(rows: DataFrame, fields: list[str], group: str, order: str, tampered: dict[str, Column] | None = None) -> DataFrame:
    """(order column, group column, position, leaf, subroot, root, path, proof_sha256, folded_root, verified), one row per row
    of ``rows``. path: the siblings before and after at each level from the leaf to the root. folded_root: the root that the
    row, with the columns in ``tampered`` replaced, and its path give."""
    sized = materialize(ranked(leaves(rows, fields, group, order, tampered or {}), ["g"], ["o", "leaf", "found"]), "merkle-leaves")
    # copies are unfolded block by block, after the exchange by block
    last = F.col("first") + F.col("copies") - 1
    spans = sized.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(last / BLOCK))))
    inside = F.sequence(F.greatest("first", F.col("block") * BLOCK), F.least(last, F.col("block") * BLOCK + BLOCK - 1))
    nodes = spans.repartition("g", "block").select("g", "n", "block", F.explode(inside).alias("at"), F.col("leaf").alias("hash"), "o", "found")

    longest = sized.agg(F.max("n")).first()[0] or 0
    stages = _stages(nodes, ["g"], ["o", "found"], longest)
    subroots = stages[-1].blocks.select("g", F.col("hash").alias("subroot"), F.lit(1).cast("long").alias("copies"))
    tops = materialize(ranked(subroots.withColumn("all", F.lit(0)), ["all"], ["g"]), "merkle-groups")
    heads = _dealt(tops.select("all", F.col("first").alias("at"), F.col("subroot").alias("hash"), "n", "g"), ["all"])
    upper = _stages(heads, ["all"], ["g"], tops.count())
    root = upper[-1].blocks.select("hash").first()  # one row, or none

    paths = tops.limit(1).select("all", F.lit(0).cast("long").alias("block"), F.array().cast(_PATH).alias("path"))
    for stage in reversed(upper[1:]):
        paths = _descend(stage, ["all"], paths, []).select("all", F.col("at").alias("block"), "path")
    groups = _descend(upper[0], ["all"], paths, ["g"])
    paths = groups.select("g", F.lit(0).cast("long").alias("block"), F.struct("path", F.col("hash").alias("subroot")).alias("up"))
    # the subroot goes down with the path, as a last step that is taken off at the leaves
    own = F.array(F.struct(F.lit(None).cast("string").alias("before"), F.col("up.subroot").alias("after")))
    paths = paths.select("g", "block", F.concat(own, "up.path").alias("path"))
    for stage in reversed(stages[1:]):
        paths = _descend(stage, ["g"], paths, []).select("g", F.col("at").alias("block"), "path")
    found = _descend(stages[0], ["g"], paths, ["o", "found"])

    path = F.filter("path", lambda p: p["before"].isNotNull())
    subroot = F.filter("path", lambda p: p["before"].isNull())[0]["after"]
    out = found.select(
        F.col("o").alias(order), F.col("g").alias(group), F.col("at").alias("position"), F.col("hash").alias("leaf"), subroot.alias("subroot"),
        F.lit(root[0] if root else None).cast("string").alias("root"), path.alias("path"), "found",
    )
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), "")
    folded = out.withColumn("proof_sha256", digest(siblings)).withColumn("folded_root", _climb(F.col("found"), F.col("path")))
    return folded.drop("found").withColumn("verified", F.col("folded_root") == F.col("root"))


#: What a document's leaf holds, in this order.
DOCUMENT = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest(docs: DataFrame, every: int = 3) -> DataFrame:
    """``proofs`` of documents by language, where those whose id's CRC-32 ``every`` divides come back with A-Z lower-cased."""
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    return proofs(docs, DOCUMENT, "lang", "doc_id", {"text": F.when(picked, ascii_lower(F.col("text"))).otherwise(F.col("text"))})
