"""The manifest against a plain tree, over one and several stages of blocks; awkward, clashing and empty tables."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from tandemetry.llm import merkle

from .helpers import AWKWARD, SCHEMA, awkward, clashing, empty, lowered


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes):
    """Root and for each leaf its siblings (before, after) level by level."""
    paths = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, who = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for j, members in enumerate(owners[a : a + 8]):
                for leaf in members:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(H(*run))
            who.append([m for o in owners[a : a + 8] for m in o])
        nodes, owners = up, who
    return nodes[0], paths


def plain(rows):
    key = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    groups = defaultdict(list)
    for doc, text, lang, source, n in rows:
        found = lowered(text) if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 else text
        leaf, seen = (H(*map(field, (doc, source, lang, n, t))) for t in (text, found))
        groups[lang].append((key(doc), leaf, seen, doc))
    subs, out = {}, []
    for g, leaves in groups.items():
        leaves.sort(key=lambda r: r[:3])
        subs[g] = plain_tree([r[1] for r in leaves])
    order = sorted(subs, key=key)
    root, tops = plain_tree([subs[g][0] for g in order])
    for g, leaves in groups.items():
        for (_, leaf, seen, doc), path in zip(leaves, subs[g][1]):
            whole, h = path + tops[order.index(g)], seen
            for b, a in whole:
                h = H(b, h, a)
            out.append((doc, leaf, subs[g][0], root, H(*(b + a for b, a in whole)), h, h == root))
    return sorted(out, key=repr)


def got(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def many():
    rows = [(i, f"Text {i % 5}", "en" if i % 3 else None, "s", i) for i in range(300)]
    rows += [(i, "Same", "de", None, None) for i in (7, 7, 7, None, None)] + [(900 + i, "X", f"l{i}", "s", 1) for i in range(12)]
    return rows


@pytest.mark.parametrize("digits", [1, 4])
def test_trees_of_any_height(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)  # one digit a block: three stages for 200 leaves
    monkeypatch.setattr(merkle, "BLOCK", 8**digits)
    assert got(merkle.manifest(spark.createDataFrame(many(), SCHEMA))) == plain(many())


def test_copies_are_unfolded_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIGITS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(5, "Copy", "en", "s", 4)] * 100 + [(1, "a", "en", "s", 1), (9, "b", "en", "s", 1)]
    assert got(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_awkward_rows(spark):
    want = plain(AWKWARD)
    assert got(merkle.manifest(awkward(spark))) == want
    assert got(merkle.manifest(clashing(awkward(spark)))) == want


def test_empty_and_lone(spark):
    assert merkle.manifest(empty(spark)).collect() == []
    (row,) = merkle.manifest(spark.createDataFrame([(1, "A", "en", "s", 1)], SCHEMA)).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == H() and row.path == []


def test_a_changed_row_is_found(spark):
    rows = [(i, "Upper", "en", "s", 1) for i in range(40)]
    for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 3 != 0)
