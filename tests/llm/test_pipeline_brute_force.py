"""Every stage of the pipeline, on its own input, against a plain version of what it must do."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline as P
from tandemetry.llm import pii
from tandemetry.llm import queries as registered
from tandemetry.llm.common import load_tokenizer
from tests.parity import connect

from .helpers import SCHEMA
from .test_llm import groups_at_08, plain_pii

SF = "/root/testdata/sf0.001"
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def plain_terms(texts, how=pii.Disclosure()):
    """Per text the (start, end, gone) of terms that disclose an entity beside them."""
    beside, holders = [], defaultdict(int)
    for i, text in enumerate(texts):
        for w in {w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if len(w) >= how.min_letters}:
            holders[w] += 1
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in plain_pii(text))]
        words = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W\d_]+", text or "")]
        for kind, a, b in spans:
            near = [w for w in words if w[2] <= a][-how.reach :] + [w for w in words if w[1] >= b][: how.reach]
            context = tuple(w for w, _, _ in near)
            for w, x, y in near:
                if y - x >= how.min_letters and not any(x < d and y > c for _, c, d in spans):
                    beside.append((i, (kind, text[a:b].lower()), w, context, x, y))
    of_pair, of_entity, contexts, words_of = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for i, e, t, c, _, _ in beside:
        of_pair[e, t].add(i)
        of_entity[e].add(i)
        contexts[e, t].add(c)
        words_of[e, c].add(t)

    def supported(e, t):
        held = []
        for c in sorted(contexts[e, t]):
            own = words_of[e, c] - {t}
            if all(own != h and len(own & h) < max(how.alike, min(len(own), len(h)) / 2) for h in held):
                held.append(own)
        return len(held) >= how.support

    share = {}
    for e, t in of_pair:
        bits = math.log2(len(texts) / len(of_entity[e]))
        if bits > 0 and supported(e, t):
            share[e, t] = math.log2(len(texts) * len(of_pair[e, t]) / (len(of_entity[e]) * holders[t])) / bits
    out = defaultdict(dict)
    for i, e, t, _, x, y in beside:
        if share.get((e, t), 0) >= how.disclose:
            out[i][x, y] = out[i].get((x, y), False) or share[e, t] >= how.remove
    return [sorted((x, y, gone) for (x, y), gone in out[i].items()) for i in range(len(texts))]


def plain_clean(text, terms):
    """Overlapping spans as one, under the mark of the first."""
    spans = [(int(a), int(b), MARKS[k]) for k, a, b in (s.split(":") for s in plain_pii(text))] + [(a, b, "" if gone else "[TERM]") for a, b, gone in terms]
    merged = []
    for a, b, mark in sorted(spans, key=lambda s: (s[0], -s[1])):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, mark])
    for a, b, mark in reversed(merged):
        text = text[:a] + mark + text[b:]
    return text


def ids_of(sql, where, texts):
    """Ids of a query's rows when documents are only those of texts."""
    con = connect(SF)
    con.sql("CREATE OR REPLACE TABLE left_ids(doc_id BIGINT)")
    con.executemany("INSERT INTO left_ids VALUES (?)", [(i,) for i in texts])
    con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet' WHERE doc_id IN (SELECT doc_id FROM left_ids)")
    return {r[0] for r in con.sql(f"SELECT doc_id FROM ({sql}) WHERE {where}").fetchall()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES:
        before, docs = texts, stage(spark, docs, SF)
        if name == "packing":
            break
        texts = {r.doc_id: r.text for r in docs.collect()}
        kept[name] = texts
        if name == "quality":
            assert set(texts) == ids_of(registered.oracle_sql()["op7_quality_rules"], "kept", before)
        elif name == "near_dedup":
            order, least = sorted(before), {}
            for i, g in zip(order, groups_at_08([before[i] for i in order])):
                least.setdefault(g, i)
            assert set(texts) == set(least.values())
        elif name == "benchmarks":
            assert set(texts) == ids_of(registered.oracle_sql()["op4_decontaminate"], "NOT contaminated", before)
        else:
            order = list(before)
            assert texts == {i: plain_clean(before[i], terms) for i, terms in zip(order, plain_terms([before[i] for i in order]))}
        if name != "privacy":
            assert all(before[i] == t for i, t in texts.items())
    tok, pieces, sequences = load_tokenizer("word_bpe_49k.json"), defaultdict(list), defaultdict(list)
    for p in docs.collect():
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    assert set(pieces) == set(before)
    for i, some in pieces.items():
        ids = np.array([*tok.encode(before[i], add_special_tokens=False).ids, 2], "<u4")
        end = 0
        for p in sorted(some, key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (end, len(ids), zlib.crc32(ids[end : end + p.length].tobytes()))
            end += p.length
        assert end == len(ids)
    for some in sequences.values():
        end = 0
        for offset, length in sorted(some):
            assert offset == end
            end += length
        assert end <= 4096
    assert sorted((p.doc_id, p.start, p.ids_crc32) for p in P.run(spark, SF).collect()) == sorted((p.doc_id, p.start, p.ids_crc32) for some in pieces.values() for p in some)


def test_terms_against_a_plain_version(spark):
    rng = np.random.default_rng(12)
    known = ["".join(rng.choice(list("bcdfghklmnprst"), 5)) for _ in range(120)]
    entities = [f"user{i}@corp.example" for i in range(12)]
    own = [f"secretish{chr(97 + i)}" for i in range(12)]
    texts = []
    for _ in range(500):
        w = list(rng.choice(known, rng.integers(3, 25)))
        for e in rng.choice(12, rng.integers(0, 3)):
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = [own[e], entities[e]] if rng.random() < 0.6 else [entities[e]]
        if rng.random() < 0.1:
            w.append(own[int(rng.integers(12))])
        texts.append(" ".join(w))
    texts += texts[:40] + ["", "alone@corp.example"]
    want = plain_terms(texts)
    assert sum(map(len, want)) > 50
    got = pii.find(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert {r.doc_id: [(t.start, t.end, t.gone) for t in r.terms] for r in got} == dict(enumerate(want))
