"""Language-model scores from a weighted backoff automaton.

The model is a trigram with Dirichlet smoothing at each order: p(w | uv) = (c(uvw) + mu3 p(w | v)) / (c(uv) + mu3),
p(w | v) = (c(vw) + mu2 p(w)) / (c(v) + mu2), over a unigram with absolute discounting whose discounted mass is the unknown
word's: p(w) = (c(w) - D) / N, p(unknown) = D V / N. As an automaton: the states are the histories, an empty one, words and
pairs of words; an arc for each n-gram seen leads to the longest history that its end is; a failure arc, taken where no arc
fits, leads from a pair to its last word and from a word to the empty state, with weight log mu / (c(history) + mu). Texts
are read once from left to right, many side by side: each carries its state and adds up the weights of the arcs it takes.

No task holds the whole model, which grows with the corpus. Documents are read in blocks of a partition of the scan,
bounded in rows and in bytes. A block sends the distinct n-grams of all its texts with their training counts, packed into sorted arrays cut into
``FAN`` ranges of their hashes. A range's task adds up the counts and answers each block in the order of the block's own
keys, so an answer is counts only. Of more than ``FAN`` blocks, groups of about that many are added up first, range by
range, and their sums are cut and sent on in the same way; the answers come back along the same tree. So a block sends and
gets a fixed number of messages at each of log(blocks) levels, and no task holds more than about ``FAN`` messages. A block
then holds just the states and arcs that its own texts can reach, and scores them. The texts themselves move once, to meet
the answers. Words and pairs are told apart by 64-bit hashes, triples by 48 bits of theirs.

An answer names the checksum of the keys it counts: a block that is read again with other rows fails instead of scoring
with another block's counts.

Defined results: a null or empty text is the end token alone; a null id is hashed as the empty text; repeated rows count
and score each; extra columns are ignored; an empty table gives an empty table; with no training text at all every token
is unknown with probability 1.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

FOLDS, HELD_OUT = 7, 2
#: Smoothing of the orders 2 and 3.
MU = (500.0, 20.0)
#: Rows of a block at most, as a power of two; ranges of a message and blocks of a group.
ROWS_LOG2, FAN = 11, 128
#: Bytes of text of a block, beside the longest text: a task's memory is some 25 times as much.
BLOCK_BYTES = 12 << 20
#: Not words, as words hold no white space.
START, END = b"\t", b"\n"


def is_held_out(name: str) -> bool:
    return zlib.crc32(name.encode()) % FOLDS == HELD_OUT


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    key = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return key ^ (key >> np.uint64(32))


class Block:
    """Texts as local word numbers. keys[k]: the sorted hashes of the distinct n-grams of order k + 1; at[k]: for each token,
    which of them ends there (of order 3: -1 at a text's first token)."""

    def __init__(self, texts: list[str | None]):
        from xxhash import xxh64_intdigest

        number = defaultdict()
        number.default_factory = number.__len__
        start, end = number[START], number[END]
        parts, sizes = [], []
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            ids = np.empty(len(words) + 2, np.int32)
            ids[0], ids[-1] = start, end
            ids[1:-1] = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
            parts.append(ids)
            sizes.append(len(words) + 1)
        self.sizes = np.array(sizes, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64) if sizes else np.empty(0, np.int64)
        stream = np.concatenate(parts) if parts else np.empty(0, np.int32)
        del parts
        h = np.fromiter(map(xxh64_intdigest, number), np.uint64, len(number))
        words = len(number)
        del number
        token = np.ones(len(stream), bool)
        token[self.first + np.arange(len(sizes))] = False
        here = np.flatnonzero(token)
        word, before = stream[here], stream[here - 1]
        rank = np.argsort(np.argsort(h))
        pairs, pair = np.unique(before.astype(np.int64) * words + word, return_inverse=True)
        hashed = _mixed(h[pairs // words], h[pairs % words])
        order = np.argsort(hashed)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pair = place[pair]
        long = np.ones(len(word), bool)
        long[self.first] = False
        inner = np.flatnonzero(long)
        triples, which = np.unique(pair[inner - 1] * words + word[inner], return_inverse=True)
        pair_keys = hashed[order]
        of_triple = _mixed(pair_keys[triples // words], h[triples % words]) & np.uint64(2**64 - 2**16)
        triple_keys, to = np.unique(of_triple, return_inverse=True)
        triple = np.full(len(word), -1, np.int64)
        triple[inner] = to[which]
        self.keys, self.at = [np.sort(h), pair_keys, triple_keys], [rank[word], pair, triple]
        self.before, self.start, self.end = rank[before], int(rank[start]), int(rank[end])

    def counts(self, train: np.ndarray) -> list[np.ndarray]:
        """Training counts in key order. train: a flag for each text."""
        of_token = np.repeat(train, self.sizes)
        return [np.bincount(at[of_token & (at >= 0)], minlength=len(keys)) for at, keys in zip(self.at, self.keys)]


def pack(values: np.ndarray, width: int) -> bytes:
    """Numbers as planes of bytes, the high planes of small numbers being zeros that compression removes."""
    return np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)), 8)


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, 8), dtype=np.uint64)


def cuts(keys: np.ndarray, ranges: int, low: int, high: int) -> np.ndarray:
    """Where the ranges low to high - 1 of so many begin in the sorted keys, and the end. A range's number is the key's
    share of all keys; ranges is a power of two."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))
    return np.searchsorted((keys >> shift).astype(np.int64), np.arange(low, high + 1))


_MESSAGE = "kind int, range long, child long, keys binary, counts binary"
_REPLY = "kind int, range long, child long, totals binary, check long"
_SUMMED = f"{_REPLY}, tokens long, types long, once long, twice long"
_SCORED = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _messages(kind: int, child: int, keys: np.ndarray, counts: np.ndarray, ranges: int, low: int, fan: int) -> pa.Table:
    at = cuts(keys, ranges, low, low + fan)
    full = [i for i in range(fan) if at[i] < at[i + 1]]
    return pa.table(
        {
            "kind": pa.array([kind] * len(full), pa.int32()),
            "range": pa.array([low + i for i in full], pa.int64()),
            "child": pa.array([child] * len(full), pa.int64()),
            "keys": pa.array([pack_keys(keys[at[i] : at[i + 1]]) for i in full], pa.binary()),
            "counts": pa.array([pack(counts[at[i] : at[i + 1]], 4) for i in full], pa.binary()),
        }
    )


def _counter(fan: int):
    """Messages of each block of rows (name, text, block), whose blocks follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, texts = None, [], []

        def made() -> Iterator[pa.RecordBatch]:
            read = Block(texts)
            for kind, (keys, n) in enumerate(zip(read.keys, read.counts(np.array([not is_held_out(x) for x in names])))):
                yield from _messages(kind, last, keys, n, fan, 0, fan).to_batches()

        for batch in batches:
            for name, text, block in zip(*(c.to_pylist() for c in batch.columns)):
                if block != last and texts:
                    yield from made()
                    names, texts = [], []
                last = block
                names.append(name)
                texts.append(text)
        if texts:
            yield from made()

    return run


def _summed(group: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The keys of each message of a range, all of them sorted, and their counts."""
    keys = [unpack_keys(k) for k in group["keys"].to_pylist()]
    n = np.concatenate([unpack(c, 4) for c in group["counts"].to_pylist()])
    union, at = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, union, np.bincount(at, weights=n).astype(np.int64)


def _replies(group: pa.Table, keys: list[np.ndarray], union: np.ndarray, total: np.ndarray) -> dict:
    return {
        "kind": group["kind"], "range": group["range"], "child": group["child"],
        "totals": pa.array([pack(total[np.searchsorted(union, k)], 4) for k in keys], pa.binary()),
        "check": pa.array([zlib.crc32(k.tobytes()) for k in keys], pa.int64()),
    }


def add_up(group: pa.Table) -> pa.Table:
    """One range of all blocks: the total counts of each block's keys, in the block's order."""
    keys, union, total = _summed(group)
    stats = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]
    zero = lambda x: pa.array([x] + [0] * (len(keys) - 1), pa.int64())
    return pa.table(_replies(group, keys, union, total) | dict(zip(("tokens", "types", "once", "twice"), map(zero, stats))))


def totals(messages: DataFrame, children: int, ranges: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """(replies, rows with the corpus' sums) for messages of so many children, cut into so many ranges."""
    if children <= fan:
        summed = materialize(messages.groupBy("kind", "range").applyInArrow(add_up, _SUMMED), "lm-totals")
        return summed.select("kind", "range", "child", "totals", "check"), summed
    messages = materialize(messages, "lm-messages")
    groups = -(-children // fan)
    grouped = messages.withColumn("parent", F.pmod(F.xxhash64("child"), F.lit(groups)))

    def merge(group: pa.Table) -> pa.Table:
        _, union, total = _summed(group)
        kind, at, parent = (group[c][0].as_py() for c in ("kind", "range", "parent"))
        return _messages(kind, parent, union, total, ranges * fan, at * fan, fan)

    def answer(asked: pa.Table, replies: pa.Table) -> pa.Table:
        keys, union, _ = _summed(asked)
        own = sorted(zip(*(replies[c].to_pylist() for c in ("range", "totals"))))
        return pa.table(_replies(asked, keys, union, np.concatenate([unpack(t, 4) for _, t in own]).astype(np.int64)))

    merged = grouped.groupBy("kind", "range", "parent").applyInArrow(merge, _MESSAGE)
    above, sums = totals(merged, groups, ranges * fan, fan)
    above = above.select("kind", F.floor(F.col("range") / fan).alias("range"), F.col("child").alias("parent"), F.col("range").alias("fine"), "totals")
    keyed = above.withColumnRenamed("range", "coarse").withColumnRenamed("fine", "range")
    both = grouped.groupBy("kind", "range", "parent").cogroup(keyed.groupBy("kind", "coarse", "parent"))
    return materialize(both.applyInArrow(answer, _REPLY), "lm-replies"), sums


@dataclass(frozen=True)
class Unigrams:
    """The corpus' totals: training tokens, types, types seen once and twice."""

    tokens: int
    types: int
    once: int
    twice: int

    def probability(self, n: np.ndarray) -> np.ndarray:
        """Of words with these counts; they and the unknown word sum to 1."""
        if not self.tokens:
            return np.ones(len(n))
        d = min(0.95, max(0.05, self.once / max(1, self.once + 2 * self.twice)))
        return np.where(n > 0, (n - d) / self.tokens, d * self.types / self.tokens)


class Automaton:
    """The states and arcs that a block's texts can reach; weights are log10 probabilities. State 0 is the empty history, 1 + w
    that of word w, 1 + V + p that of pair p."""

    def __init__(self, block: Block, counts: list[np.ndarray], unigrams: Unigrams, mu: tuple[float, float]):
        """Counts in key order."""
        words, pairs, triples = counts
        V = len(words)
        history = words.copy()
        history[block.start] = words[block.end]  # as many texts begin as end
        word, before = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        word[block.at[1]], before[block.at[1]] = block.at[0], block.before
        p1 = unigrams.probability(words)
        p2 = (pairs + mu[0] * p1[word]) / (history[before] + mu[0])
        inner = np.flatnonzero(block.at[2] >= 0)
        end, begin = np.zeros(len(triples), np.int64), np.zeros(len(triples), np.int64)
        end[block.at[2][inner]], begin[block.at[2][inner]] = block.at[1][inner], block.at[1][inner - 1]
        p3 = (triples + mu[1] * p2[end]) / (pairs[begin] + mu[1])
        self.fails_to = np.concatenate([[0], np.zeros(V, np.int64), 1 + word])
        self.failure = np.concatenate([[0.0], np.log10(mu[0] / (history + mu[0])), np.log10(mu[1] / (pairs + mu[1]))])
        # arcs of each order: whether the n-gram was seen, its weight, the state it leads to
        longest = np.where(pairs > 0, 1 + V + np.arange(len(pairs)), 1 + word)
        self.arcs = [(np.ones(V, bool), np.log10(p1), None), (pairs > 0, np.log10(p2), longest), (triples > 0, np.log10(p3), longest[end])]
        self.words, self.begin = V, 1 + block.start

    def traverse(self, block: Block) -> np.ndarray:
        """The log probability of each text: all texts advance a token at a time, longest first, each from its own state."""
        order = np.argsort(-block.sizes, kind="stable")
        first, sizes = block.first[order], block.sizes[order]
        state, score = np.full(len(order), self.begin, np.int64), np.zeros(len(order))
        running = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")
        for step, n in enumerate(running):
            at = first[:n] + step
            now, add, to = state[:n], np.zeros(n), np.zeros(n, np.int64)
            waiting = np.arange(n)
            for k in (2, 1, 0):  # a text whose state is of order k looks for an arc; without one it fails to order k - 1
                level = (now[waiting] > 0).astype(np.int64) + (now[waiting] > self.words)
                mine = waiting[level == k]
                seen, weight, target = self.arcs[k]
                arc = block.at[k][at[mine]]
                fits = seen[arc]
                hit = mine[fits]
                add[hit] += weight[arc[fits]]
                to[hit] = target[arc[fits]] if k else 1 + arc
                miss = mine[~fits]
                add[miss] += self.failure[now[miss]]
                now[miss] = self.fails_to[now[miss]]
                waiting = np.concatenate([waiting[level != k], miss]) if k else waiting[:0]
            score[:n] += add
            # after an unseen pair the state is the last word's
            state[:n] = to
        out = np.empty(len(order))
        out[order] = score
        return out


def _scorer(unigrams: Unigrams, mu: tuple[float, float]):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(docs["text"].to_pylist())
        counts = []
        for kind, keys in enumerate(block.keys):
            own = sorted((b, t, c) for k, b, t, c in zip(*(replies[c].to_pylist() for c in ("kind", "range", "totals", "check"))) if k == kind)
            n = [unpack(t, 4) for _, t, _ in own]
            counts.append(np.concatenate(n).astype(np.int64) if n else np.empty(0, np.int64))
            edges = np.cumsum([len(x) for x in n])
            if len(counts[-1]) != len(keys) or any(zlib.crc32(part.tobytes()) != c for part, (_, _, c) in zip(np.split(keys, edges[:-1]), own)):
                raise ValueError("a block's texts differ from those that were counted; write the input to a table first (stable=False)")
        n = counts[0][block.at[0]]
        base = np.log10((n + 1) / (unigrams.tokens + unigrams.types + 1))
        add = lambda x: np.add.reduceat(x, block.first)
        held = [is_held_out(x) for x in docs["name"].to_pylist()]
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "held_out": pa.array(held, pa.bool_()),
                "n_tokens": pa.array(block.sizes),
                "n_known": pa.array(add((n > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(held), unigrams.tokens)),
                "base_score": pa.array(add(base)),
                "score": pa.array(Automaton(block, counts, unigrams, mu).traverse(block)),
            }
        )

    return run


def _fitting(rows: DataFrame, rows_log2: int, most: int) -> int:
    """The largest power of two of rows, up to rows_log2, whose blocks hold at most ``most`` bytes of text and the longest text."""
    sizes = rows.select(F.monotonically_increasing_id().alias("id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("b"))
    while rows_log2 > 0:
        blocks = sizes.groupBy(F.shiftright("id", rows_log2)).agg(F.sum("b").alias("b"), F.max("b").alias("m"))
        largest, longest = blocks.agg(F.max("b"), F.max("m")).first()
        if not largest or largest <= most + longest:
            break
        rows_log2 = max(0, rows_log2 - max(1, (largest // (most + longest)).bit_length() - 1))
    return rows_log2


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu: tuple[float, float] = MU, stable: bool = False, rows_log2: int = ROWS_LOG2, fan: int = FAN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row. stable: docs is a plain read of
    files, whose partitions are the same each time; else the rows are first written to the shared folder. fan: a power of two."""
    prepare(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    if not stable:
        rows = materialize(rows, "lm-rows")
    rows_log2 = _fitting(rows, rows_log2, block_bytes)
    block = F.shiftright(F.monotonically_increasing_id(), rows_log2).alias("block")
    rows = rows.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text", block)
    per_part = rows.groupBy(F.shiftright("block", 33 - rows_log2).alias("part")).agg(F.max("block").alias("last"))
    in_part = F.col("last") - F.shiftleft("part", 33 - rows_log2) + 1
    children = per_part.agg(F.coalesce(F.sum(in_part), F.lit(0))).first()[0]
    messages = rows.select("name", "text", "block").mapInArrow(_counter(fan), _MESSAGE)
    replies, summed = totals(messages, children, fan, fan)
    sums = summed.filter(F.col("kind") == 0).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "once", "twice")]).first()
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_SCORED}"
    return rows.groupBy("block").cogroup(replies.withColumnRenamed("child", "block").groupBy("block")).applyInArrow(_scorer(Unigrams(*sums), mu), schema)
