"""Benchmark decontamination by one Aho-Corasick automaton over the normalised windows of test questions and answers.

Texts are normalised on their UTF-8 bytes (A-Z lowered, cut into words) and scanned once, word by word: the items' words
are the automaton's alphabet, so a match's end is its last word, and words map back to character offsets of the original
text. Every window of ``window`` words of an item is a pattern, so any passage of at least that many words of an item is
found wherever it lies.

The automaton goes to every worker, so its size is bounded: at most ``max_bytes`` by the measured bytes of a word of a
window. More windows are split into blocks by hash and scanned block after block, hits carried along in a column and each
round written to the shared folder. A worker process builds the automaton once.

Defined results: a null text or one without words has no hits; an item without words is no pattern; an item with a null
id marks words as hit but isn't listed; equal items count once per id; repeated rows are each scanned; extra columns are
ignored by ``scan`` and kept by ``drop_contaminated``; an empty table of items leaves every document clean.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat
from math import isqrt
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

WINDOW = 10
#: Characters of a word's code; bytes of an automaton per word of a window, as measured; bytes of an automaton.
WIDTH, WORD_BYTES, MAX_BYTES = 2, 100, 256 << 20
#: Fixed value: a word is a run of ASCII digits and letters and of all characters beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: For lowered UTF-8 bytes: what isn't a word's becomes a space.
TABLE = bytes(c if c >= 0x80 or chr(c).isdigit() or "a" <= chr(c) <= "z" else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Normalised words; bytes.lower and bytes.split know ASCII only, and in TABLE's output a space is the only white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(TABLE).split()


@dataclass(frozen=True)
class Windows:
    """The windows of a set of items, ready for the broadcast: words as codes of WIDTH characters, patterns of codes."""

    key: str
    codes: dict[bytes, str]
    patterns: list[tuple[str, tuple[int, ...]]]
    names: list[str]


def windows_of(items: Iterable[tuple[list[str], str | None]], window: int = WINDOW, part: int = 0, parts: int = 1) -> Windows:
    """The windows of (ids, text) that fall in one of so many parts. A word's code is two characters of disjoint alphabets,
    so a match begins and ends with a word, and no state of the automaton has more arcs than the root of the vocabulary."""
    number: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[int]] = {}
    names: list[str] = []
    for ids, text in items:
        words = words_of(text)
        size = min(window, len(words))
        mine = []
        for i in range(len(words) - size + 1 if size else 0):
            some = words[i : i + size]
            if zlib.crc32(b" ".join(some)) % parts == part:
                mine.append(tuple(number.setdefault(w, len(number)) for w in some))
        if mine:
            listed = range(len(names), len(names) + len(ids))
            names.extend(ids)
            for key in mine:
                found.setdefault(key, set()).update(listed)
    base = isqrt(len(number)) + 1
    coded = [chr(1 + i // base) + chr(0x1000 + i % base) for i in range(len(number))]
    patterns = [("".join(coded[i] for i in key), tuple(sorted(ids))) for key, ids in found.items()]
    return Windows(uuid4().hex, dict(zip(number, coded)), patterns, names)


#: The automaton that this worker built last, by the key of its windows.
_BUILT: dict[str, object] = {}


def automaton(windows: Windows):
    """Built once for a worker process, not for each task; None without patterns."""
    import ahocorasick

    if windows.key not in _BUILT:
        _BUILT.clear()
        auto = ahocorasick.Automaton()
        for p, ids in windows.patterns:
            auto.add_word(p, (len(p) // WIDTH, ids))
        if windows.patterns:
            auto.make_automaton()
        _BUILT[windows.key] = auto if windows.patterns else None
    return _BUILT[windows.key]


def _scan_words(auto, windows: Windows, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Runs of hit words (first, last + 1), merged, and the names of the items found."""
    if auto is None or not words:
        return [], set()
    runs, items = [], set()
    for end, (size, ids) in auto.iter("".join(map(windows.codes.get, words, repeat("  ")))):
        last = (end + 1) // WIDTH
        runs.append((last - size, last))
        items.update(ids)
    return _merged(sorted(runs)), {windows.names[i] for i in items}


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in runs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as character offsets of the text as it was."""
    if not runs:
        return []
    at = [m.span() for m in WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)}))]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, max_bytes: int) -> Iterator[Windows]:
    """Windows in blocks that an automaton may hold, each window in one block by its hash, so that neither a long item nor
    many items of one text make a block large. Equal texts are one item with many ids. Spark counts the words first; the
    driver reads the items once per block, partition by partition, and holds one block."""
    rows = items.groupBy(items[text_col].alias("text")).agg(F.sort_array(F.collect_set(items[id_col].cast("string"))).alias("ids"))
    words = rows.agg(F.coalesce(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))), F.lit(0))).first()[0]
    parts = int(words) * window * WORD_BYTES // max_bytes + 1
    for part in range(parts):
        yield windows_of(((r.ids, r.text) for r in rows.toLocalIterator()), window, part, parts)


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items (sorted ids), spans (array of start, end in characters of the original), contaminated."""
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    carried = f"doc_id {kind}, text string, runs array<bigint>, items array<string>"
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.array().cast("array<bigint>").alias("runs"), F.array().cast("array<string>").alias("items"))
    blocks = _blocks(items, item_id, item_text, window, max_bytes)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(block)
        rows = rows.mapInArrow(_round(shared, last=following is None), carried if following is not None else _RESULT.format(kind=kind))
        if following is not None:
            rows = materialize(rows, "decontaminate")
        block = following
    return rows


_RESULT = "doc_id {kind}, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start: int, end: int>>, contaminated boolean"


def _round(shared, last: bool):
    """The task's function: add this block's hits; after the last block, sum up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        auto = automaton(windows)
        for batch in batches:
            ids, texts, before, listed = batch.columns
            out = defaultdict(list)
            for text, old, had in zip(texts.to_pylist(), before.to_pylist(), listed.to_pylist()):
                words = words_of(text)
                runs, items = _scan_words(auto, windows, words)
                runs = _merged(sorted(runs + list(zip(old[::2], old[1::2])))) if old else runs
                items = sorted(items.union(had))
                if last:
                    out["n_words"].append(len(words))
                    out["n_hit"].append(sum(b - a for a, b in runs))
                    out["n_items"].append(len(items))
                    out["spans"].append([{"start": a, "end": b} for a, b in original_spans(text, runs)] if runs else [])
                else:
                    out["runs"].append([x for r in runs for x in r])
                out["items"].append(items)
            strings = pa.array(out["items"], pa.list_(pa.string()))
            if not last:
                yield pa.RecordBatch.from_arrays([ids, texts, pa.array(out["runs"], pa.list_(pa.int64())), strings], names=["doc_id", "text", "runs", "items"])
                continue
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(out[c], pa.int64()) for c in ("n_words", "n_hit", "n_items")), strings, pa.array(out["spans"], span), pa.array([n > 0 for n in out["n_hit"]], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items", "spans", "contaminated"],
            )

    return run


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of docs without a hit, all columns as they were. The row travels beside the text as its own id, so nothing is joined."""
    row = F.struct(*[docs[c] for c in docs.columns])
    found = scan(docs.select(row.alias("doc_id"), docs[text_col].alias("text")), items, "doc_id", "text", item_id, item_text, window, max_bytes)
    return found.filter(~F.col("contaminated")).select("doc_id.*")
