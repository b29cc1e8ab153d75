"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits agree in one of their two halves up to one bit. So each
distinct fingerprint is indexed under its halves with one bit blanked (a wildcard): 64 variants; equal keys meet by
partitioning and sorting, and are verified by Hamming distance.

A key shared by more than ``RUN`` fingerprints isn't compared all with all: its members go on to a second key that adds
the other half cut in two with one bit blanked, and from there to a third that adds a byte. A pair within three bits
shares a key at every level, so no link is lost, and at the third level the distinct fingerprints under a key are at most
2048, as only eleven bits are free. Within a key only the links of a spanning forest leave the task, never all pairs.

``COPIES`` links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Their fingerprints
differ in up to 0.15 of the bits, so one blanked bit isn't enough: the fingerprint has ``WORDS`` words of 64 bits, and each
word is indexed under ``VARIANTS`` keys in which all but ``KEPT`` of its bits are blanked. Equal keys meet, and nodes that
differ in at most ``FAR`` bits of the ``SEEN`` words after the key's are candidates, so a pair that one word leaves out may
be met by another; a key of more than ``RUN`` nodes isn't verified, all its nodes are candidates. A pair at 0.8 is missed
with chance 5 in 100,000 (49 of 1,000,000 drawn), and less above; with few shingles ties decide more of the bits: of 40,000
drawn pairs of five and six shingles 8 were missed, of six and seven 6, of four and five 1.1 in 100. Keys are dealt out in
rounds of ``ROUND`` a node, so no more of them lie on disk at once, and little of a row can be compressed, so it's as large
in a larger table.
The components of candidates hold every pair met. Only their members' texts are
fetched, and inside a component the sets themselves are compared, rarest shingles first: only pairs at 0.8 or more, by
exact count, are linked. A component of more than ``BLOCK`` nodes is dealt out to blocks twice, by two hashes, and compared
inside them, which is linear in the nodes and connects nearly all of a hot template. What is left open is compared block
against block, each with each that could hold a partner and isn't connected with it already, so no link is lost; the
groups grow with the component only if a few of its nodes are left, and with the square where it falls into many clusters.
Equal sets are one node, named by a hash of the set.

Copies share a fingerprint and are one node. Components come from repeated minimum and pointer jumping over tables in the
shared folder.

Defined results: a null or empty text has fingerprint 0 and links like any other; a null id never names a component, and
a component of null ids only has a null id; repeated rows each get a row; extra columns are ignored by ``classes`` and
kept by ``one_of_each``; an empty table gives an empty table. A text of fewer than three words is one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Fingerprints under one key that are compared in place.
RUN = 4096
COPY_SHINGLE, WORDS, VARIANTS, KEPT = 5, 24, 16, 20
#: The words after the key's that are compared, and the bits in which candidates differ there; at similarity 0.8 the mean is 20, the deviation 4.1.
SEEN, FAR = 2, 32
#: Keys of a node that are dealt out at once; of fewer nodes more, up to so many rows.
ROUND, ROUND_ROWS = 32, 2_000_000
#: Nodes, and bytes of their sets, that a block of a component holds.
BLOCK, BLOCK_BYTES = 1000, 1 << 24
#: Rows of a batch of sets.
BATCH = 500
#: Edges that one task contracts.
CHUNK = 200_000


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only, which is what the definition asks for."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def majority(h: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65280):
        bits = np.unpackbits(h[i : i + 65280].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if len(bits) % 255:
            bits = np.concatenate([bits, np.zeros((255 - len(bits) % 255, 64), np.uint8)])
        ones += bits.reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def _hashes(parts) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.uint64)


def _shingles(words: list[bytes], shingle: int) -> np.ndarray:
    return _hashes([b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)))))


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    return majority(_shingles(words, shingle)) if words else 0


def simhash_signature(words: list[bytes]) -> tuple[int, ...]:
    return (fingerprint(words, SHINGLE),)


_RNG = np.random.default_rng(SEED)
_FACTOR, _SHIFT = _RNG.integers(0, 2**64, (2, WORDS), np.uint64) | np.array([[1], [0]], np.uint64)
#: The bits that stay, for each variant of each word, as signed 64-bit words.
_MASKS = np.array([sum(1 << int(b) for b in _RNG.choice(64, KEPT, replace=False)) for _ in range(WORDS * VARIANTS)], np.uint64).view(np.int64).tolist()
_TIES = _RNG.integers(0, 2, 64 * WORDS)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """The bits set in over half of WORDS hashes for each of the set h, as signed 64-bit words. Half of an even number gives
    the bit of _TIES: were a shingle counted twice, sets that differ in it would lie far apart."""
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(h), 255):
        x = h[i : i + 255, None] * _FACTOR + _SHIFT
        x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        bits = np.unpackbits((x ^ x >> np.uint64(29)).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.uint8)
    return np.packbits(2 * ones + _TIES > len(h), bitorder="little").view(np.int64)


def shingle_set(words: list[bytes]) -> tuple[int, np.ndarray]:
    """A hash of the set of five-word shingles, and the set as sorted 64-bit hashes."""
    h = np.unique(_shingles(words, COPY_SHINGLE))
    return int(_hashes([h.tobytes()]).view(np.int64)[0]), h


def copies_signature(words: list[bytes]) -> tuple[int, int, np.ndarray]:
    """A hash of the set of five-word shingles, its size, and its fingerprint."""
    if not words:
        return 0, 0, np.empty(0, np.int64)
    name, h = shingle_set(words)
    return name, len(h), wide_fingerprint(h)


@dataclass(frozen=True)
class Scheme:
    """columns: name and type of what ``sign`` makes of a text's words, first fp, a text's node; edges: (a, b) between the
    nodes, from such a table, docs and the names of its id and text."""

    columns: tuple[tuple[str, pa.DataType], ...]
    sign: Callable
    edges: Callable[[DataFrame, DataFrame, str, str], DataFrame]


def signatures(docs: DataFrame, id_col: str, text_col: str, scheme: Scheme) -> DataFrame:
    """doc_id and the scheme's columns for each row."""
    prepare(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    columns, sign = scheme.columns, scheme.sign
    names = ["doc_id", *(n for n, _ in columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                made = [sign(words_of(t)) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[i] for m in made], t) for i, (_, t) in enumerate(columns))], names=names)

    return rows.mapInArrow(run, ", ".join([f"doc_id {rows.schema['doc_id'].dataType.simpleString()}", *(f"{n} {_SQL[t]}" for n, t in columns)]))


_SQL = {pa.int64(): "long", pa.list_(pa.int64()): "array<long>"}


def _blanked(part: Column, width: int, code: int, bit: int) -> Column:
    """A key of a part's number, the blanked bit and the part without it; code and bit are plain numbers."""
    return F.lit((code * width + bit) << width) + part.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << bit)))


def _halves(fp: Column) -> list[Column]:
    return [fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)]


def _first_keys(segments: list[Column]) -> Column:
    """32 keys for each segment: its number, blanked bit, 32 bits."""
    return F.array(*[_blanked(h, 32, i, b) for i, h in enumerate(segments) for b in range(32)])


def _second_keys(k1: Column, fp: Column) -> Column:
    """32 keys over the half that k1 doesn't hold: quarter of the whole, blanked bit, 16 bits."""
    other = F.when(F.shiftrightunsigned(k1, 37) == 0, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(F.lit(0xFFFFFFFF)))
    quarters = (other.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(other, 16))
    return F.array(*[_blanked(q, 16, i, b) for i, q in enumerate(quarters) for b in range(16)])


def _third_keys(k1: Column, k2: Column, fp: Column) -> Column:
    """16 keys, each k2 with a byte of the quarter that neither k1 nor k2 holds."""
    other = F.when(F.shiftrightunsigned(k1, 37) == 0, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(F.lit(0xFFFFFFFF)))
    quarter = F.when(F.shiftrightunsigned(k2, 20) == 0, F.shiftrightunsigned(other, 16)).otherwise(other.bitwiseAND(F.lit(0xFFFF)))
    octets = (quarter.bitwiseAND(F.lit(0xFF)), F.shiftrightunsigned(quarter, 8))
    return F.array(*[F.shiftleft(k2, 16) + _blanked(o, 8, i, b) for i, o in enumerate(octets) for b in range(8)])


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of each row's component, after linking rows a with rows b. root: the same before."""
    a, b = root[a], root[b]
    while (apart := a != b).any():
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up
        a, b = root[a], root[b]
    return root


def _links(longest: int | None, bits: int):
    """The task's function over rows (k1, k2, fp) sorted by key: links of a spanning forest of each key, or, for a key
    with more than ``longest`` fingerprints, each row with the key's first, to be dealt out under finer keys. More columns
    are the words of the fingerprint that fp names."""

    def batch_of(crowded: bool, k1, k2, a, b) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, crowded)), *(pa.array(x.astype(np.int64)) for x in (k1, k2, a, b))], names=["crowded", "k1", "k2", "a", "b"])

    def compare(k1, k2, fp, *words) -> Iterator[pa.RecordBatch]:
        """Rows of whole keys only."""
        words = words or (fp,)
        n = len(fp)
        if n < 2:
            return
        cut = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
        start = np.concatenate([[0], cut])
        size = np.diff(np.concatenate([start, [n]]))
        run, whole = np.repeat(np.arange(len(size)), size), np.repeat(size, size)
        if longest is not None and (big := whole > longest).any():
            yield batch_of(True, k1[big], k2[big], fp[start][run[big]], fp[big])
        live = np.flatnonzero((whole > 1) & ((whole <= longest) if longest is not None else True))
        root, d = np.arange(n), 1
        while True:
            live = live[live + d < n]
            live = live[run[live] == run[live + d]]
            if not len(live):
                break
            apart = live[root[live] != root[live + d]]
            near = apart[sum(np.bitwise_count((w[apart] ^ w[apart + d]).view(np.uint64)).astype(np.int16) for w in words) <= bits]
            root = _join(root, near, near + d)
            if d % 32 == 0:  # a key whose rows are all connected has nothing to add
                done = np.minimum.reduceat(root, start) == np.maximum.reduceat(root, start)
                live = live[~done[run[live]]]
            d += 1
        tip = np.flatnonzero(root != np.arange(n))
        if len(tip):
            yield batch_of(False, k1[tip], k2[tip], fp[root[tip]], fp[tip])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last key's rows so far: it may go on in the next batch
        passing = False  # the last key is known to be crowded: its rows go out as they come
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if passing:
                same = (new[0] == last[0]) & (new[1] == last[1])
                if same.any():
                    yield batch_of(True, *(x[same] for x in new[:2]), np.full(same.sum(), head), new[2][same])
                if same.all():
                    continue
                passing, new = False, [x[~same] for x in new]
            rows = [np.concatenate([h, x]) for h, x in zip(held, new)] if held else new
            last = (rows[0][-1], rows[1][-1])
            first = int(np.argmax((rows[0] == last[0]) & (rows[1] == last[1])))
            yield from compare(*(x[:first] for x in rows))
            held = [x[first:] for x in rows]
            if longest is not None and len(held[0]) > longest:
                head = held[2][0]
                yield batch_of(True, *held[:2], np.full(len(held[2]), head), held[2])
                held, passing = None, True
        if held:
            yield from compare(*held)

    return run


_LINKS = "crowded boolean, k1 long, k2 long, a long, b long"


def _linked(rows: DataFrame, finer: list[Callable[[DataFrame], DataFrame]], bits: int) -> DataFrame:
    """Edges from rows (k1, k2, fp). finer: from crowded rows to rows under finer keys, level by level."""
    prepare(rows.sparkSession)
    edges = None
    for level in range(len(finer) + 1):
        last = level == len(finer)
        dealt = rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "fp")
        out = materialize(dealt.mapInArrow(_links(None if last else RUN, bits), _LINKS), f"links{level}")
        found = out.filter(~F.col("crowded")).select("a", "b")
        edges = found if edges is None else edges.union(found)
        rest = out.filter("crowded").select("k1", "k2", F.col("b").alias("fp"))
        if last or rest.isEmpty():
            return _contracted(edges.distinct())
        rows = finer[level](rest)


def _contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: a forest of each chunk of edges, as a pair met under many keys has many paths."""
    edges = materialize(edges, "edges")
    chunks = edges.count() // CHUNK + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        a, b = (np.concatenate([e[i] for e in ends] or [np.empty(0, np.int64)]) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = _join(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
        tip = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[root[tip]]), pa.array(nodes[tip])], names=["a", "b"])

    return edges.repartition(chunks).mapInArrow(run, "a long, b long")


def links(fps: DataFrame, *_) -> DataFrame:
    """Edges (a, b) that connect all fingerprints fp within MAX_BITS of each other."""
    distinct = fps.select("fp").distinct()
    # dealt out anew: narrow rows are read in few partitions, and each makes 64
    dealt = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    rows = dealt.select(F.explode(_first_keys(_halves(F.col("fp")))).alias("k1"), F.lit(0).cast("long").alias("k2"), "fp")
    second = lambda rest: rest.select("k1", F.explode(_second_keys(F.col("k1"), F.col("fp"))).alias("k2"), "fp")
    third = lambda rest: rest.select("k1", F.explode(_third_keys(F.col("k1"), F.col("k2"), F.col("fp"))).alias("k2"), "fp")
    return _linked(rows, [second, third], MAX_BITS)


def _alike(fps: list[int], known: list[int], sets: list[bytes]) -> Iterator[tuple[int, int]]:
    """Links that connect all nodes whose sets have a similarity of 0.8 or more. Two such sets share one of the fifth of
    their shingles that are rarest here; pairs that links connect already, or that are known as one, aren't compared."""
    size = np.array([len(s) // 8 for s in sets])
    _, ids, count = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True, return_counts=True)
    ids = ids[np.lexsort((ids, count[ids], np.repeat(np.arange(len(size)), size)))]
    ends = np.cumsum(size)
    own = [ids[e - n : e] for e, n in zip(ends, size)]
    marked = np.zeros(len(count), bool)
    holders: dict[int, int] = {}  # sets of nodes are the bits of a number
    place: dict[int, int] = {}
    root, members = [place.setdefault(k, i) for i, k in enumerate(known)], [0] * len(size)
    for i, r in enumerate(root):
        members[r] |= 1 << i
    for i, mine in enumerate(own):
        first = mine[: size[i] // 5 + 1]
        met = 0
        for shingle in first[count[first] > 1].tolist():
            met |= holders.get(shingle, 0)
            holders[shingle] = holders.get(shingle, 0) | 1 << i
        met &= ~members[root[i]]
        marked[mine] = True
        while met:
            j = met.bit_length() - 1
            met ^= 1 << j
            if 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j]) and 9 * np.count_nonzero(marked[own[j]]) >= 4 * (size[i] + size[j]):
                keep, give = sorted((root[i], root[j]), key=lambda r: -members[r].bit_count())
                yield fps[keep], fps[give]  # the components' ends: links to the last partner would be a long chain
                rest = members[give]
                joined = members[keep] = members[keep] | rest
                while rest:
                    at = rest.bit_length() - 1
                    root[at] = keep
                    rest ^= 1 << at
                met &= ~joined
        marked[mine] = False


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group of rows (g, fp, known, set) sorted by g."""
    last, fps, names, sets = None, [], [], []

    def made() -> pa.RecordBatch:
        found = list(_alike(fps, names, sets)) if len(fps) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for g, fp, name, one in zip(*(c.to_pylist() for c in batch.columns)):
            if g != last and fps:
                yield made()
                fps, names, sets = [], [], []
            last = g
            fps.append(fp)
            names.append(name)
            sets.append(one)
    if fps:
        yield made()


def _many() -> Column:
    """The blocks that rows with a size need, in nodes and in bytes."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).cast("long")


def _compare(rows: DataFrame) -> DataFrame:
    """Links of each group g of rows (g, fp, known, set)."""
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_compared, "a long, b long")


def _across(big: DataFrame, links: DataFrame) -> DataFrame:
    """The links that ``links`` leaves open among rows (root, fp, size, set) of components of several blocks. A cluster that
    ``links`` connects and that fills a block has blocks of its own, which aren't compared with each other; all other nodes
    share blocks. Blocks go by class of size, similar sets being of one or of neighbouring classes; a group is a pair of blocks."""
    inside = links.join(big.select(F.col("fp").alias("a")), "a", "left_semi")
    clusters = components(_contracted(inside)).select(F.col("node").alias("fp"), F.col("root").alias("cluster"))
    fine = F.floor(F.log("size") / F.log(F.lit(1.3))).cast("long")
    nodes = big.select("root", "fp", "size", fine.alias("class")).join(clusters, "fp", "left").withColumn("known", F.coalesce("cluster", "fp"))
    large = nodes.groupBy("known").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= BLOCK).select("known", F.col("known").alias("own"))
    kind = [F.col("own").isNotNull().alias("pure"), F.coalesce("own", F.lit(0)).alias("kind")]
    nodes = materialize(nodes.join(large, "known", "left").select("root", "fp", "size", "class", "known", *kind), "nodes")
    keys = ["root", "class", "pure", "kind"]
    blocks = materialize(nodes.groupBy(*keys).agg(_many().alias("blocks")), "blocks")
    near = F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)]))
    others = blocks.select("root", near.alias("class"), F.struct("class", "pure", "kind", "blocks").alias("o"))
    both = nodes.join(blocks, keys).join(others, ["root", "class"]).filter(~(F.col("pure") & F.col("o.pure") & (F.col("kind") == F.col("o.kind"))))
    mine = F.xxhash64("root", "class", "pure", "kind", F.pmod("fp", "blocks"))
    each = both.select("fp", "known", mine.alias("mine"), "root", "o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o.blocks") - 1)).alias("at"))
    other = F.xxhash64("root", "o.class", "o.pure", "o.kind", "at")
    groups = each.select("fp", "known", F.xxhash64(F.least("mine", other), F.greatest("mine", other)).alias("g"))
    return _compare(big.select("fp", "set").join(groups, "fp").select("g", "fp", "known", "set"))


def _candidates(nodes: DataFrame) -> DataFrame:
    """Edges that connect the nodes (fp, bits) that meet under a key and differ in at most FAR bits, and all of a crowded key."""
    key = F.col("key")
    word = lambda i: F.col("bits")[(key + i) % WORDS]
    # two words that change from key to key: a row has the same few bytes in as many partitions as there may be, where four
    # fixed ones were compressed away only while rows of a node lay side by side
    columns = [word(0).bitwiseAND(F.lit(_MASKS)[key]).alias("k1"), key.cast("long").alias("k2"), "fp", *(word(i + 1).alias(f"w{i}") for i in range(SEEN))]
    size, edges = max(ROUND, ROUND_ROWS // max(nodes.count(), 1)), None
    for at in range(0, len(_MASKS), size):
        keys = F.explode(F.sequence(F.lit(at), F.lit(min(at + size, len(_MASKS)) - 1)))
        rows = nodes.select(keys.alias("key"), "fp", "bits").select(*columns)
        met = rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "fp").mapInArrow(_links(RUN, FAR), _LINKS)
        found = materialize(met.filter("a != b").select("a", "b").distinct(), "met")
        edges = found if edges is None else edges.union(found)
    return edges


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, root, size, blocks, set) of the rows whose last column, the text, is the node's: an id may stand in rows of several texts."""
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            made = [shingle_set(w) if (w := words_of(t)) else (0, np.empty(0, np.uint64)) for t in batch.column(4).to_pylist()]
            own = pa.array([m[0] == fp for m, fp in zip(made, batch.column(0).to_pylist())], pa.bool_())
            sets = pa.array([m[1].tobytes() for m in made], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], sets], names=["fp", "root", "size", "blocks", "set"]).filter(own)


def copy_links(signed: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) that connect the nodes with a similarity of 0.8 or more that share a key."""
    prepare(signed.sparkSession)
    # sets of fewer than four shingles have no partner but equal ones: the next larger one would be at 3 of 4
    nodes = signed.filter("size > 3").groupBy("fp").agg(F.any_value("bits").alias("bits"))
    # dealt out once for all rounds: narrow rows are written in few files, and each makes many
    nodes = materialize(nodes.repartition(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp"), "nodes")
    near = materialize(components(_contracted(_candidates(nodes).distinct())), "near")
    rows = signed.select("doc_id", "fp", "size").join(near, F.col("fp") == F.col("node")).groupBy("root", "fp", "size", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    members = materialize(rows.groupBy("root", "fp", "size").agg(F.min_by("doc_id", "doc_id").alias("member"), F.max("rows").alias("rows")), "members")
    whole = members.groupBy("root").agg(_many().alias("blocks"))
    wanted = members.select("root", "fp", "size", "member").join(whole, "root")
    texts = docs.select(docs[id_col].alias("row_id"), docs[text_col].alias("text"))
    # a merge join at every size: the members' texts are a share of all texts, so their list grows with the input
    fetched = texts.join(wanted.hint("merge"), F.col("row_id").eqNullSafe(F.col("member"))).select("fp", "root", "size", "blocks", "text")
    sets = fetched.mapInArrow(_sets, "fp long, root long, size long, blocks long, set binary")
    if not members.filter("rows > 1 or member is null").isEmpty():
        sets = sets.groupBy("fp", "root", "size", "blocks").agg(F.any_value("set").alias("set"))
    sets = materialize(sets, "sets")
    turn = lambda i: F.xxhash64("root", F.lit(i), F.pmod(F.xxhash64("fp", F.lit(i)), "blocks"))
    turns = F.when(F.col("blocks") == 1, F.array(turn(0))).otherwise(F.array(turn(0), turn(1)))
    found = materialize(_compare(sets.select(F.explode(turns).alias("g"), "fp", F.col("fp").alias("known"), "set")), "copies")
    big = sets.filter("blocks > 1")
    return found if big.isEmpty() else found.union(materialize(_across(big, found), "copies"))


SIMHASH = Scheme((("fp", pa.int64()),), simhash_signature, links)
COPIES = Scheme((("fp", pa.int64()), ("size", pa.int64()), ("bits", pa.list_(pa.int64()))), copies_signature, copy_links)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is one node of its component, the same for all."""
    edges = materialize(edges, "edges")  # read in both directions, so both must see the same forest
    both = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")), "edges")
    now = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "roots")
    while True:
        near = both.join(now, both["v"] == now["node"]).groupBy("u").agg(F.min("root").alias("near"))
        low = now.join(near, now["node"] == near["u"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("low"))
        jump = now.select(F.col("node").alias("at"), F.col("root").alias("above"))
        step = low.join(jump, F.col("low") == F.col("at")).select("node", F.col("above").alias("root"), (F.col("above") != F.col("old")).alias("moved"))
        step = materialize(step, "roots")
        now = step.select("node", "root")
        if step.filter("moved").isEmpty():
            return now


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = SIMHASH) -> DataFrame:
    """doc_id, fingerprint (16 hex digits; the name of its node), component_id (the smallest doc_id of the component) for each row of docs."""
    signed = materialize(signatures(docs, id_col, text_col, scheme), "signed")
    least = signed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(scheme.edges(signed, docs, id_col, text_col)).withColumnRenamed("node", "fp")
    named = least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(ids, "root").select("fp", "component_id")
    return signed.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = COPIES) -> DataFrame:
    """The row of docs with the smallest id of each component, whole. Rows that share that id (repeats) give the least one;
    a component of null ids gives its least row. Texts are moved only for such ties, else a narrow list of ids decides."""
    fps = materialize(signatures(docs, id_col, text_col, scheme), "signed")
    roots = components(scheme.edges(fps, docs, id_col, text_col))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("doc_id", F.coalesce("root", "fp").alias("root"))
    counted = named.groupBy("root", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    least = counted.groupBy("root").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "rows"))).alias("first"))
    least = materialize(least, "kept")
    kept = least.filter(F.col("first").isNotNull()).select(F.col("first.doc_id").alias("kept_id"), (F.col("first.rows") > 1).alias("tied"), "root")
    repeats = kept.groupBy("kept_id").agg(F.max("tied").alias("tied"), F.count(F.lit(1)).alias("groups"))
    once = repeats.filter(~F.col("tied") & (F.col("groups") == 1)).select("kept_id")
    # an id that stands in several rows: their texts may lie in different components, so the rows are told apart by root
    tied_ids = fps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter((F.col("rows") > 1) | F.col("doc_id").isNull())
    alone = once.join(tied_ids, F.col("kept_id") == F.col("doc_id"), "left_anti")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"), docs[id_col].alias("row_id"), docs[text_col].alias("row_text"))
    simple = rows.join(alone.hint("merge"), F.col("row_id") == F.col("kept_id"), "left_semi").select("r.*")
    if tied_ids.isEmpty():
        return simple
    unclear = rows.join(tied_ids, F.col("row_id").eqNullSafe(F.col("doc_id")), "left_semi")
    again = signatures(unclear.select(F.struct("r", "row_id").alias("t"), "row_text"), "t", "row_text", scheme)
    placed = again.join(roots, again["fp"] == roots["node"], "left").select(F.col("doc_id.r").alias("r"), F.col("doc_id.row_id").alias("row_id"), F.coalesce("root", "fp").alias("at"))
    chosen = least.select(F.col("root"), F.col("first.doc_id").alias("kept_id"))
    decided = placed.join(chosen, (F.col("at") == F.col("root")) & F.col("row_id").eqNullSafe(F.col("kept_id")))
    return simple.unionByName(decided.groupBy("at").agg(F.min("r").alias("r")).select("r.*"))
