"""The pipeline's stages, each on its own input, and the whole."""

from collections import Counter

import corpus_pipeline as P

from tandemetry.llm import near_dedup

from .helpers import awkward, clashing, empty, words

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_awkward_rows(spark):
    for docs in (clashing(awkward(spark)), empty(spark)):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            out.collect()
        P.STAGES[-1][1](spark, docs, SF).collect()


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    cur, seen = docs, {}
    for name, stage in P.STAGES[:-1]:
        cur = stage(spark, cur, SF)
        seen[name] = {r.doc_id: r.text for r in cur.collect()}
    good = seen["quality"]
    assert all(len(words(t)) >= 10 for t in good.values())
    # one of each group of exact copies stays, the one with the smallest id
    first = {}
    for i in sorted(good):
        first.setdefault(good[i], i)
    assert set(seen["near_dedup"]) <= set(first.values())
    assert set(seen["near_dedup"]) == {r.component_id for r in near_dedup.classes(docs.filter(docs.doc_id.isin(list(good))), scheme=near_dedup.COPIES).collect()}
    assert set(seen["benchmarks"]) < set(seen["near_dedup"]) and set(seen["privacy"]) == set(seen["benchmarks"])
    assert all(texts[i] == t for i, t in seen["benchmarks"].items())
    assert not any("@mail" in t for t in seen["privacy"].values())
    got = P.run(spark, SF).collect()
    assert {p.doc_id for p in got} == set(seen["privacy"])
    assert sum(p.length for p in got) == sum({p.doc_id: p.doc_tokens for p in got}.values())
    assert max(Counter(p.sequence_id for p in got).values()) >= 1
