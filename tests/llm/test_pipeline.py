"""Every stage of the pipeline does its operator's work on all that the one before kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from conftest import SMALL

from tests.llm import brute
from tests.llm.test_contracts import check_pieces
from tidewatch.llm import common, mixing, toxicity


def test_stages_follow_one_another(spark):
    docs = common.documents(spark, SMALL)
    every = docs.collect()
    kept = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, SMALL)
    assert kept.schema == docs.schema
    scores = toxicity.score(docs, common.labels(spark, SMALL)).where(f"score < {toxicity.CUT}").collect()
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in scores)
    kept = common.written(kept, "test")
    rows = kept.orderBy("doc_id").collect()
    roots = brute.components([r.text for r in rows])
    alone = common.written(corpus_pipeline.drop_near_copies(spark, kept, SMALL), "test")
    want = {r.doc_id for k, r in enumerate(rows) if roots[k] == k}
    assert {r.doc_id for r in alone.collect()} == want and alone.count() == len(want)
    clean = common.written(corpus_pipeline.redact_secrets(spark, alone, SMALL), "test")
    assert clean.count() == alone.count() and not any(brute.secrets(r.text) for r in clean.collect())
    mixed = common.written(corpus_pipeline.mix_sources(spark, clean, SMALL), "test")
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(clean).collect() if r.taken}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(taken) and mixed.schema == docs.schema
    packed = corpus_pipeline.pack_sequences(spark, mixed, SMALL).collect()
    check_pieces(packed, [(r.doc_id, r.text) for r in mixed.select("doc_id", "text").collect()])
    assert len(every) > clean.count()


def test_the_run_is_its_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for start in (odd, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = common.written(stage(spark, docs, SMALL), f"test-{name}")
        assert (docs.count() == 0) == (start is none)
