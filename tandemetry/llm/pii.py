"""Personal data: patterns, and information-theoretic sanitisation of the terms that give protected entities away.

An entity is the value of a base span (an email, ip, card or phone). Its context is the ``REACH`` words on either side.
Over all documents the corpus tells how strongly a term reveals an entity: PMI(e, t) = log2(D n(e,t) / (n(e) n(t))), of
the IC(e) = log2(D / n(e)) bits that name the entity; n counts documents, D of them. A term whose share PMI / IC reaches
``disclose`` and that stands beside the entity in at least ``support`` different contexts is disclosing there: it is
generalised, or removed where its share reaches ``remove``. Contexts are different if, the term aside, they have fewer
than ``alike`` words or fewer than half the smaller one's words in common: the contexts of exact or near copies of one
page hardly differ, count once, and don't make its words disclosing. An entity is judged however often it is mentioned.

Flagged occurrences are keyed by a hash of the text, joined to documents by it. Counts of terms are combined in each task
before they are shuffled, and only terms near an entity often enough are counted at all. No list of terms or entities is
collected; the joins are plain equi-joins whose sides the planner measures.

Defined results: a null or empty text has no spans; a null id stays null; repeated rows give the same spans each and
count as documents each; extra columns are ignored by ``find`` and kept by ``sanitise``; empty tables give empty tables.
Offsets are in code points, the end exclusive. Where spans overlap, ``sanitise`` replaces their union once, named after
the first.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

BASE = ("email", "ip", "card", "phone")
#: The base kinds' patterns. Two are guarded so that a long run is tried once, from its start, where a
#: match would have to begin; emails are found from their @ for the same reason.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]+")
#: Parts in which the contexts of one pair are thinned.
PARTS = 64
MARK = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "gone": ""}


@dataclass(frozen=True)
class Disclosure:
    """Thresholds. reach: words on either side; support: different contexts; alike: words that copies
    of a context share at least; disclose, remove: shares of IC."""

    reach: int = 6
    support: int = 3
    disclose: float = 0.9
    remove: float = 0.999
    alike: int = 4
    min_letters: int = 3


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(rank of the kind, start, end), by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".") if len(p) < 100) and all(len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            found.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((3, *m.span()))
    return found


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def near_terms(text: str, spans: list[tuple[int, int, int]], how: Disclosure) -> list[dict]:
    """The terms beside each entity: entity, term and context as hashes, and where the term stands. A context's words are whole
    ones, however far off; a word that a base span touches is no term."""
    words = [m.span() for m in WORD.finditer(text)]
    starts, ends = [x for x, _ in words], [y for _, y in words]
    inside = set()
    for _, a, b in spans:
        inside.update(range(bisect_right(ends, a), bisect_left(starts, b)))
    out = []
    for rank, a, b in spans:
        entity = _hash(BASE[rank], text[a:b].lower())
        before, after = bisect_right(ends, a), bisect_left(starts, b)
        near = [*range(max(0, before - how.reach), before), *range(after, min(len(words), after + how.reach))]
        context = _hash(*(text[slice(*words[i])].lower() for i in near))
        for i in near:
            x, y = words[i]
            if y - x >= how.min_letters and i not in inside:
                out.append({"entity": entity, "term": _hash(text[x:y].lower()), "context": context, "start": x, "end": y})
    return out


_NEAR = "array<struct<entity: bigint, term: bigint, context: bigint, start: int, end: int>>"
_SPANS = "array<struct<rank: int, start: int, end: int>>"


def _scan(how: Disclosure):
    span = pa.list_(pa.struct([("rank", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    near = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("context", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, spans, terms = [], [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text or "")
                spans.append([{"rank": r, "start": a, "end": b} for r, a, b in found])
                terms.append(near_terms(text, found, how) if found else [])
                blobs.append(hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest() if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.string()), pa.array(spans, span), pa.array(terms, near)], names=["doc_id", "blob", "spans", "near"])

    return run


def _term_counter(how: Disclosure, most: int = 500_000):
    """Documents that hold each term, combined in the task and handed on whenever ``most`` terms are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def made() -> pa.RecordBatch:
            rows = [(_hash(w), n) for w, n in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update({w for w in WORD.findall((text or "").lower()) if len(w) >= how.min_letters})
                if len(seen) > most:
                    yield made()
        yield made()

    return run


def _differing(how: Disclosure):
    """Of each pair's rows (entity, term, part, context, words), sorted by the first four, up to ``support`` different contexts."""

    def same(a: frozenset, b: frozenset) -> bool:
        return a == b or len(a & b) >= max(how.alike, min(len(a), len(b)) / 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            keep = []
            pairs = zip(*(batch.column(i).to_pylist() for i in range(3)))
            words = batch.column(4)
            for i, pair in enumerate(pairs):
                if pair != last:
                    last, held = pair, []
                if len(held) < how.support:
                    own = frozenset(words[i].as_py()) - {pair[1]}
                    if not any(same(own, h) for h in held):
                        held.append(own)
                        keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return run


def supported(beside: DataFrame, how: Disclosure) -> DataFrame:
    """(entity, term) of the pairs with ``support`` different contexts. The contexts of a pair are thinned in PARTS parts, by
    the context's hash, then together, each time in the hash's order, so that no task holds them all and the result is one."""
    rows = beside.select("entity", "term", "context").distinct()
    often = rows.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= how.support).select("entity", "term")
    often = materialize(often, "often")
    words = rows.join(often.select("entity").distinct(), "entity", "left_semi").groupBy("entity", "context").agg(F.collect_set("term").alias("words"))
    held = rows.join(often, ["entity", "term"], "left_semi").join(words, ["entity", "context"])
    kind = "entity long, term long, part long, context long, words array<long>"
    for part in (F.pmod("context", F.lit(PARTS)), F.lit(0).cast("long")):
        held = held.select("entity", "term", part.alias("part"), "context", "words").repartition("entity", "term", "part")
        held = held.sortWithinPartitions("entity", "term", "part", "context").mapInArrow(_differing(how), kind)
    return held.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= how.support).select("entity", "term")


def disclosing(docs: DataFrame, scanned: DataFrame, text_col: str, how: Disclosure) -> DataFrame:
    """(blob, start, end, gone) of each occurrence of a disclosing term beside its entity. scanned: what ``_scan`` made of docs."""
    # numbered before the explode: in one select with it, each occurrence would count as a document
    numbered = scanned.filter(F.size("near") > 0).select("blob", F.monotonically_increasing_id().alias("row"), "near")
    beside = numbered.select("blob", "row", F.explode("near").alias("o")).select("blob", "row", "o.*")
    wanted = materialize(supported(beside, how), "pairs")
    if wanted.isEmpty():
        return scanned.sparkSession.createDataFrame([], "blob string, start int, end int, gone boolean")
    both = beside.join(wanted, ["entity", "term"], "left_semi")
    n_pair = both.select("entity", "term", "row").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_pair"))
    of_entity = beside.join(wanted.select("entity").distinct(), "entity", "left_semi")
    n_entity = of_entity.select("entity", "row").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    terms = docs.select(docs[text_col].alias("text")).mapInArrow(_term_counter(how), "term long, n long")
    # written, as the planner may take it up in several joins, and each would read all texts again
    n_term = materialize(terms.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_term")), "term-counts")
    total = F.lit(scanned.count()).cast("double")
    pmi = F.log2(total * F.col("n_pair") / (F.col("n_entity") * F.col("n_term")))
    bits = F.log2(total / F.col("n_entity"))
    share = F.when(bits > 0, pmi / bits).otherwise(0.0)
    judged = n_pair.join(n_entity, "entity").join(n_term, "term").select("entity", "term", share.alias("share")).filter(F.col("share") >= how.disclose)
    placed = beside.select("blob", "entity", "term", "start", "end").distinct().join(judged, ["entity", "term"])
    return placed.groupBy("blob", "start", "end").agg(F.max(F.col("share") >= how.remove).alias("gone"))


def _found(docs: DataFrame, id_col: str, text_col: str, how: Disclosure) -> tuple[DataFrame, DataFrame]:
    prepare(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scanned = materialize(rows.mapInArrow(_scan(how), f"doc_id {kind}, blob string, spans {_SPANS}, near {_NEAR}"), "pii")
    terms = disclosing(docs, scanned, text_col, how)
    # its own table, so that the planner knows its size: few terms are broadcast, and the texts stay where they are
    return scanned, materialize(terms.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end", "gone"))).alias("terms")), "terms")


_TERMS = "array<struct<start: int, end: int, gone: boolean>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, spans (rank of base kind, start, end) and terms (start, end, gone) for each row."""
    scanned, terms = _found(docs, id_col, text_col, how)
    none = F.array().cast(_TERMS)
    some = scanned.filter(F.size("near") > 0).join(terms, "blob", "left").select("doc_id", "spans", F.coalesce("terms", none).alias("terms"))
    return some.unionByName(scanned.filter(F.size("near") == 0).select("doc_id", "spans", none.alias("terms")))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans as text (base kinds, then terms)."""
    names = F.array(*[F.lit(k) for k in BASE])
    base = F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"]))
    more = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"]))
    of_rank = lambda i: F.filter("spans", lambda s: s["rank"] == i)
    counts = [F.size(of_rank(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans"))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with the union of overlapping spans replaced by the mark of the first."""
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], MARK[kind]]
        at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, how: Disclosure = Disclosure()) -> DataFrame:
    """docs with personal data replaced in the text (and length_col set to its new length in characters), other columns as they were."""
    _, terms = _found(docs, id_col, text_col, how)
    columns = docs.columns
    row = F.struct(*[docs[c] for c in columns])
    rows = docs.select(row.alias("r"), docs[text_col].alias("text"), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("row_blob"))
    joined = rows.join(terms, F.col("row_blob") == F.col("blob"), "left").select("r", "text", F.coalesce("terms", F.array().cast(_TERMS)).alias("terms"))
    kind = joined.schema["r"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, terms in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = [(a, b, BASE[r]) for r, a, b in base_spans(text or "")]
                spans += [(t["start"], t["end"], "gone" if t["gone"] else "term") for t in terms]
                texts.append(redact(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["r", "clean"])

    clean = joined.mapInArrow(run, f"r {kind}, clean string")
    out = []
    for c in columns:
        value = F.col("r")[c]
        if c == text_col:
            value = F.col("clean")
        elif c == length_col:
            value = F.when(F.col("clean") == F.col("r")[text_col], value).otherwise(F.length("clean").cast(docs.schema[c].dataType))
        out.append(value.alias(c))
    return clean.select(*out)
