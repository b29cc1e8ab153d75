"""Vector bin packing of training examples under limits on tokens, segments and loss-bearing tokens at once.

Each task packs what it reads: an open sequence takes, again and again, the waiting piece whose demand has the largest
dot product with the sequence's remaining room (all three as shares of their limits), until none fits; then the piece
that can give the most is cut to fill the rest. For documents, a sequence that runs out of segments before is cut back to a power
of two. Only a bounded pool of pieces waits, so memory doesn't grow with the
input, nothing is shuffled, and a lost task is simply run again. The last pieces of a task, too few for a full sequence,
go to sequences whose lengths are powers of two, which need no padding.

Loss-bearing tokens are an example's last ones (the answer after the prompt); without a loss column all of them are. Of a
document's text of several lines the first is the prompt, as in instruction data that is kept as plain text; a text of one
line bears loss throughout.

Defined results for documents: a null or empty text is the one end id; null ids stay null; repeated rows are packed
each; extra columns are ignored; an empty table gives no piece. Sequence ids are unique, not consecutive: the task's
number in the upper bits, a counter in the lower. For examples, a null or negative number of tokens or of loss-bearing
tokens counts as 0, more loss-bearing tokens than tokens as all, and an example without tokens gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load_tokenizer, prepare
from .pretokens import Runs, ids_as_bytes, plain_space

END_ID = 2


@dataclass(frozen=True)
class Limits:
    """Of one sequence. pool: pieces that wait at most; a task's memory is about pool * tokens ids. powers: a sequence that
    another limit ends before its tokens is cut back to a power of two, for padding that spares such lengths."""

    tokens: int = 4096
    segments: int = 512
    loss: int = 4096
    pool: int = 512
    powers: bool = False


class Packer:
    """Streams pieces in, finished sequences out. ``place`` is called with (key, start, length, sequence, offset)."""

    def __init__(self, limits: Limits, place, first_sequence: int):
        self.limits, self.place, self.sequence = limits, place, first_sequence
        size = limits.pool + 1
        self.keys: list = [None] * size
        self.start, self.left, self.prompt = (np.zeros(size, np.int64) for _ in range(3))
        self.n = 0

    def add(self, key, tokens: int, loss: int) -> None:
        """An example of so many tokens, the last ``loss`` of them loss-bearing."""
        start, prompt, most = 0, tokens - loss, self.limits.tokens
        while tokens - start >= most and self.limits.segments > 0:  # whole sequences of their own
            take = min(most, max(0, prompt - start) + self.limits.loss)
            if take < most:
                break
            self.place(key, start, take, self.sequence, 0)
            self.sequence += 1
            start += take
        if start == tokens:
            return
        i = self.n
        self.keys[i], self.start[i], self.left[i], self.prompt[i] = key, start, tokens - start, max(0, prompt - start)
        self.n += 1
        if self.n > self.limits.pool:
            while self.n > self.limits.pool // 2:
                self.fill(most)

    def fill(self, most: int) -> None:
        """One sequence of at most so many tokens from the pool."""
        while True:
            before = self.n, self.keys[: self.n], self.start[: self.n].copy(), self.left[: self.n].copy(), self.prompt[: self.n].copy()
            chosen = self._chosen(most)
            length = sum(c[2] for c in chosen)
            if not self.limits.powers or length == most or not length & (length - 1):
                break
            n = before[0]
            self.n, self.keys[:n], self.start[:n], self.left[:n], self.prompt[:n] = before
            most = 1 << (length.bit_length() - 1)
        for key, start, take, offset in chosen:
            self.place(key, start, take, self.sequence, offset)
        self.sequence += bool(chosen)

    def _chosen(self, most: int) -> list[tuple]:
        """(key, start, length, offset) of the pieces that one sequence takes from the pool."""
        lim, chosen = self.limits, []
        room, slots, loss_room, offset = most, lim.segments, lim.loss, 0
        while room and slots and self.n:
            left, prompt = self.left[: self.n], self.prompt[: self.n]
            loss = left - prompt
            fits = (left <= room) & (loss <= loss_room)
            if fits.any():
                score = left * (room / lim.tokens**2) + loss * (loss_room / max(1, lim.loss) ** 2)  # the segment term is the same for all
                i = int(np.argmax(np.where(fits, score, -1.0)))
                take = int(left[i])
            else:
                can = np.minimum(np.minimum(left, room), prompt + loss_room)
                i = int(np.argmax(can))
                take = int(can[i])
                if take <= 0:
                    break
            chosen.append((self.keys[i], int(self.start[i]), take, offset))
            offset += take
            room -= take
            slots -= 1
            loss_room -= max(0, take - int(prompt[i]))
            if take == left[i]:
                last = self.n - 1
                self.keys[i], self.start[i], self.left[i], self.prompt[i] = self.keys[last], self.start[last], self.left[last], self.prompt[last]
                self.keys[last] = None
                self.n = last
            else:
                self.start[i] += take
                self.left[i] -= take
                self.prompt[i] = max(0, int(self.prompt[i]) - take)
        return chosen

    def finish(self) -> None:
        while self.n:
            total = int(self.left[: self.n].sum())
            self.fill(min(self.limits.tokens, 1 << (total.bit_length() - 1)))


def pack_examples(df: DataFrame, id_col: str, tokens_col: str, loss_col: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Instruction data whose token counts are known: id, start, length, sequence_id, offset, loss (loss-bearing tokens in the piece)."""
    prepare(df.sparkSession)
    count = lambda c: F.greatest(F.coalesce(df[c].cast("long"), F.lit(0)), F.lit(0))
    rows = df.select(df[id_col].alias("id"), count(tokens_col).alias("n"), (F.least(count(loss_col), count(tokens_col)) if loss_col else count(tokens_col)).alias("loss"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, start long, length long, sequence_id long, offset long, loss long"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def place(key, start, length, sequence, offset):
            at, n, loss = key
            out.append((at, start, length, sequence, offset, max(0, start + length - max(start, n - loss))))

        def made() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [kind] + [pa.int64()] * 5)], names=["id", "start", "length", "sequence_id", "offset", "loss"])

        packer, kind = Packer(limits, place, TaskContext.get().partitionId() << 40), pa.null()
        for batch in batches:
            kind = batch.column(0).type
            for at, n, loss in zip(*(c.to_pylist() for c in batch.columns)):
                packer.add((at, n, loss), n, loss)
            yield made()
        packer.finish()
        if out:
            yield made()

    return rows.mapInArrow(pack, schema)


def encode_document(text: str, runs: Runs) -> bytes:
    """The text's ids as bytes. The tokenizer drops white space and joins nothing across it, so runs encode on their own."""
    return b"".join(map(runs.__getitem__, text.split())) if plain_space(text) else runs.whole(text)


def prompt_length(text: str, runs: Runs) -> int:
    """Tokens of the first line of a text of several lines."""
    first, cut, _ = text.partition("\n")
    return len(encode_document(first, runs)) // 4 if cut else 0


#: For documents: a sequence of a few long ones has few segments, one of short ones is closed by the segments.
DOCUMENTS = Limits(segments=128, powers=True)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limits: Limits = DOCUMENTS, end_id: int = END_ID) -> DataFrame:
    """Tokenize whole texts (then the end id) and pack them. tokenizer: a file of the tokenizers library that drops white
    space. One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), ids_crc32, doc_tokens, sequence_id, offset."""
    prepare(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    end = ids_as_bytes([end_id])
    names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, out = Runs(load_tokenizer(tokenizer), ids_as_bytes, b"".join), []

        def place(key, start, length, sequence, offset):
            at, ids = key
            piece = ids[4 * start : 4 * (start + length)]
            out.append((at, start, length, piece, zlib.crc32(piece), len(ids) // 4, sequence, offset))

        def made(kind: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else kind if n == "doc_id" else pa.int64()) for n, c in zip(names, cols)], names=names)

        packer, kind = Packer(limits, place, TaskContext.get().partitionId() << 40), pa.null()
        for batch in batches:
            kind = batch.column(0).type
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode_document(text or "", runs) + end
                packer.add((at, ids), len(ids) // 4, len(ids) // 4 - prompt_length(text or "", runs))
                if len(out) >= 5000:
                    yield made(kind)
        packer.finish()
        if out:
            yield made(kind)

    return rows.mapInArrow(pack, schema)
