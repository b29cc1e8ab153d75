"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast hash table of the corpus' most frequent pre-tokens and their lengths in tokens; tier two is a
cache in each Python worker, filled by encoding the pre-tokens that the table lacks. A pre-token here is a run of
non-space characters with the one space before it, or a run of white space: a union of whole matches of the tokenizer's
own split pattern, so the lengths of a text without special strings add up exactly. A text that holds one of the
tokenizer's special strings is encoded whole by the library, which cuts it there first. No pre-token is shuffled; to find
the frequent ones each task sends a summary of at most ``slots`` entries.

The table decides only which tier answers, never a count. Its size is bounded by ``slots``
whatever the corpus.

Defined results: a null or empty text has 0 bytes and 0 tokens; null ids stay null; repeated rows are counted each;
extra columns are ignored; an empty table gives an empty table. Texts are read whole, in slices of matches, so a very
long text needs no more memory than itself. A text with white space beyond ASCII is encoded whole by the library, as
libraries differ on what white space is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load_tokenizer, materialize, prepare
from .pretokens import LONGEST, Runs, added_strings, plain_space

SLOTS = 16384
PIECE = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")


def pieces(text: str) -> Iterator[list[str]]:
    """The pre-tokens of a text, in lists of bounded length."""
    if len(text) < 4_000_000:
        yield PIECE.findall(text)
        return
    found = (m[0] for m in PIECE.finditer(text))
    while part := list(islice(found, 500_000)):
        yield part


def frequent_pieces(docs: DataFrame, text_col: str, slots: int = SLOTS) -> list[str]:
    """The pre-tokens that make up at least 1 / slots of all texts, so at most ``slots``: each task keeps a lossy count
    (pruned when it exceeds eight times ``slots``) and sends its top ``slots``; the summaries are added up."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in pieces(text or ""):
                    seen.update(part)
                    if len(seen) > 8 * slots:
                        seen = Counter(dict(seen.most_common(2 * slots)))
        top = [(p, n) for p, n in seen.most_common(slots) if n > 1 and len(p) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    found = docs.select(docs[text_col].alias("text")).mapInArrow(summarise, "piece string, n long")
    counts = materialize(found.groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return [r.piece for r in counts.filter(F.col("n") * slots >= total).collect()]  # at most ``slots`` rows


def token_counts(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row. tokenizer: a file of the tokenizers library."""
    spark = docs.sparkSession
    prepare(spark)
    frequent = frequent_pieces(docs, text_col, slots)
    tok = load_tokenizer(tokenizer)
    lengths = {p: len(tok.encode(p, add_special_tokens=False).ids) for p in frequent}
    table = spark.sparkContext.broadcast(lengths)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = load_tokenizer(tokenizer)
        known, cache, special = table.value.get, Runs(library, len, sum), added_strings(library)

        def tokens(text: str) -> int:
            if not plain_space(text) or special.search(text):
                return cache.whole(text)
            n = 0
            for part in pieces(text):
                hits = list(map(known, part))
                if None in hits:
                    n += sum(h if h is not None else cache[p] for p, h in zip(part, hits))
                else:
                    n += sum(hits)
            return n

        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [tokens(t) if t else 0 for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
