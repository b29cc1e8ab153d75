"""A quality classifier over bytes: a convolutional network in NumPy, fitted on a bounded sample and applied to every whole text.

A byte is its eight bits as -1 and 1. Filters of eight bytes go over the text in steps of two; chunks of 512 bytes, each
overlapping half of the one before, cover it from end to end, and of each filter the largest response in a chunk is kept,
if positive. The mean and the maximum over a text's chunks, weighted and summed, give one probability. Only the running sum
and maximum of a text are held, so a text's length doesn't matter for memory.

The fit: at most ``TRAIN_ROWS`` labelled texts of each class, the first by a hash of the id, none longer than ``TRAIN_BYTES``;
a class that has more labels than are taken weighs as much more, so that scores keep the corpus' proportions. The sample
of ids is bounded, so it is broadcast; texts are scored where they are read, nothing is shuffled but the sample.

Defined results: a null or empty text has no chunks and gets the score of the bias; bytes past the last step are padded with
blanks; repeated rows have equal scores; a null id is in no sample and not held out; of several texts of one id the smallest
is fitted; without labels of both classes every score is the share of label 1 (0.5 without any label); ids labelled both
ways are left out of the fit. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

WIDTH, STRIDE, FILTERS = 8, 2, 32
#: Windows of half a chunk: chunks of 512 bytes, every 256 bytes.
HALF = 128
#: Halves that are computed at once.
BLOCK = 64
#: The bound of the sample: rows of a class, bytes of a text.
TRAIN_ROWS, TRAIN_BYTES = 1500, 32_768
STEPS, BATCH, RATE, DECAY, SEED = 500, 32, 0.01, 1e-4, 20
THRESHOLD = 0.7


def windows(text: np.ndarray) -> np.ndarray:
    """(window, bit): the bits of every window of a text's bytes, padded with blanks to the last step."""
    n = max(0, -(-(len(text) - WIDTH) // STRIDE)) + 1
    padded = np.full((n - 1) * STRIDE + WIDTH, 32, np.uint8)
    padded[: len(text)] = text
    bits = np.unpackbits(padded[:, None], axis=1).astype(np.float32) * 2 - 1
    return np.lib.stride_tricks.as_strided(bits, (n, WIDTH * 8), (STRIDE * bits.strides[0], bits.strides[1]))


@dataclass
class Net:
    """Filters (bit, filter) with biases, the weights of means and maxima, the bias of the sum."""

    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float = 0.0
    moments: dict = field(default_factory=dict, repr=False)

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Net:
        filters = rng.normal(size=(WIDTH * 8, FILTERS)).astype(np.float32) / np.sqrt(WIDTH * 8)
        return cls(filters, np.full(FILTERS, -0.5, np.float32), rng.normal(size=2 * FILTERS).astype(np.float32) * 0.1)

    def pooled(self, text: bytes) -> np.ndarray:
        """The means and maxima of a whole text, block by block."""
        data = np.frombuffer(text, np.uint8)
        if not len(data):
            return np.zeros(2 * FILTERS, np.float32)
        step = BLOCK * HALF * STRIDE
        total, most, count, last = np.zeros(FILTERS), np.zeros(FILTERS, np.float32), 0, None
        for at in range(0, max(1, len(data) - WIDTH + STRIDE), step):
            x = windows(data[at : at + step + WIDTH - STRIDE])
            out = x @ self.filters + self.bias
            halves = np.maximum(np.maximum.reduceat(out, np.arange(0, len(out), HALF)), 0)
            chain = halves if last is None else np.vstack([last, halves])
            chunks = np.maximum(chain[1:], chain[:-1])
            total, count, last = total + chunks.sum(0), count + len(chunks), halves[-1:]
            most = np.maximum(most, halves.max(0))
        return np.concatenate([total / count if count else last[0], most]).astype(np.float32)

    def score(self, text: bytes) -> float:
        return _sigmoid(float(self.pooled(text) @ self.weights) + self.offset)

    def gradients(self, text: np.ndarray, label: int) -> tuple[float, dict[str, np.ndarray]]:
        """The loss of one text and its derivatives: of a chunk only the window of a filter's largest response counts."""
        if not len(text):
            p = _sigmoid(self.offset)
            return _loss(p, label), {"offset": np.array(p - label)}
        x = windows(text)
        out = x @ self.filters + self.bias
        k = -(-len(out) // HALF)
        cut = np.full((k * HALF, FILTERS), -np.inf, np.float32)
        cut[: len(out)] = out
        cut = cut.reshape(k, HALF, FILTERS)
        where = cut.argmax(1)
        peaks = np.take_along_axis(cut, where[:, None], 1)[:, 0]
        first = np.arange(max(1, k - 1))[:, None] + (peaks[1:] > peaks[:-1] if k > 1 else np.zeros((1, FILTERS), int))
        chunks = np.maximum(np.take_along_axis(peaks, first, 0), 0)
        best = chunks.argmax(0)
        pooled = np.concatenate([chunks.mean(0), chunks.max(0)])
        p = _sigmoid(float(pooled @ self.weights) + self.offset)
        miss = p - label
        back = np.repeat(self.weights[None, :FILTERS] * miss / len(chunks), len(chunks), 0)
        back[best, np.arange(FILTERS)] += self.weights[FILTERS:] * miss
        back *= chunks > 0
        at = first * HALF + np.take_along_axis(where, first, 0)  # (chunk, filter): the window that a chunk kept
        return _loss(p, label), {
            "filters": np.einsum("cf,cfd->df", back, x[at]), "bias": back.sum(0), "weights": pooled * miss, "offset": np.array(miss),
        }

    def step(self, sums: dict[str, np.ndarray], t: int, rate: float) -> None:
        """One step of Adam."""
        for name, g in sums.items():
            now = np.asarray(getattr(self, name))
            g = g + DECAY * now * (name in ("filters", "weights"))
            m, v = self.moments.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.moments[name] = m, v
            new = now - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            setattr(self, name, float(new) if name == "offset" else new.astype(np.float32))


def _sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _loss(p: float, label: int) -> float:
    return float(-np.log(max(1e-12, p if label else 1 - p)))


def fit(texts: list[bytes], labels: list[int], weights: list[float], steps: int = STEPS, seed: int = SEED) -> Net:
    """A network fitted to texts in mini-batches with as many of either class, whose gradients carry the weights of what the
    classes are in the corpus."""
    rng = np.random.default_rng(seed)
    net = Net.fresh(rng)
    data, y, w = [np.frombuffer(t, np.uint8) for t in texts], np.array(labels), np.array(weights, float)
    share = float((w * y).sum() / w.sum()) if len(y) else 0.5
    net.offset = float(np.log(share / (1 - share))) if 0 < share < 1 else 60.0 * share - 30.0
    if len(set(labels)) < 2:
        net.weights[:] = 0
        return net
    sides = [np.flatnonzero(y == c) for c in (0, 1)]
    mass = [w[s].sum() / w.sum() for s in sides]
    queues: list[list[int]] = [[], []]
    for t in range(1, steps + 1):
        sums: dict[str, np.ndarray] = {}
        for c in (0, 1):
            if len(queues[c]) < BATCH // 2:
                queues[c] += [i for _ in range(1 + BATCH // len(sides[c])) for i in rng.permutation(sides[c]).tolist()]
            some, queues[c] = queues[c][: BATCH // 2], queues[c][BATCH // 2 :]
            for i in some:
                for name, g in net.gradients(data[i], c)[1].items():
                    sums[name] = sums.get(name, 0.0) + g * (2 * mass[c] / BATCH)
        net.step(sums, t, RATE * min(1.0, 2 * (1 - t / (steps + 1))))
    return net


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[list, list, list]:
    """Texts, labels and weights of the bounded sample, in the order of their hashes."""
    known = labels.filter(~held_out(id_col) & F.col(id_col).isNotNull() & F.col("quality").isin(0, 1))
    known = known.groupBy(id_col).agg(F.min("quality").alias("y"), F.max("quality").alias("other")).filter("y = other").select(F.col(id_col).alias("id"), "y")
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit(SEED), "id")
    taken = None
    for c in (0, 1):
        part = known.filter(F.col("y") == c).orderBy(order, "id").limit(rows)
        taken = part if taken is None else taken.unionByName(part)
    short = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.octet_length("text") <= most)
    found = short.join(F.broadcast(taken), "id").groupBy("id", "y").agg(F.min("text").alias("text")).orderBy(order, "id").collect()  # of known size
    sizes = {c: sum(r.y == c for r in found) for c in (0, 1)}
    return [r.text.encode() for r in found], [r.y for r in found], [totals[r.y] / sizes[r.y] for r in found]


def scores(docs: DataFrame, net: Net, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every whole text."""
    prepare(docs.sparkSession)
    net = Net(net.filters, net.bias, net.weights, net.offset)
    held = docs.sparkSession.sparkContext.broadcast(net)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([held.value.score(t.as_py() or b"") for t in batch.column(2)], float)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    read = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return read.mapInArrow(apply, f"`{id_col}` {read.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the sample, then ``scores`` of all documents."""
    prepare(docs.sparkSession)
    return scores(docs, fit(*sample(docs, labels)), threshold)
