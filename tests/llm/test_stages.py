"""Every stage of the pipeline on nulls, empty and unspaced texts, repeats, clashing names and empty tables."""

import random

import pytest

import corpus_pipeline
from sheaf.llm import near_copies, simhash, toxicity

from test_operators import clash

SF = "/root/testdata/sf0.001"
NAMES = ("__pred", "lang_pred", "SCORE", "hits", "n_words", "item_ids", "component_id", "node", "fp", "__s", "__copies", "ids", "part", "__place", "__bucket", "digest")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, tricky, empty, name, stage):
    last = name == corpus_pipeline.STAGES[-1][0]
    docs = clash(tricky, *NAMES)
    found = stage(spark, docs, SF)
    rows = found.collect()
    if last:
        assert [r.n_tokens >= 1 for r in rows] == [True] * docs.count() and sorted(r.start for r in rows)[0] == 0
    else:
        assert found.columns == docs.columns and found.dtypes == docs.dtypes
        texts = {(r.doc_id, r.text) for r in docs.collect()}
        assert {(r.doc_id, r.text) for r in rows} <= texts
        if name == "language ID":
            assert {r.doc_id for r in rows}.isdisjoint({6, 7, 8}) and {1, 4, 9, 11} <= {r.doc_id for r in rows}
        if name == "near-dedup":
            kept = [r.doc_id for r in rows]
            assert kept.count(12) == 1 and 2 not in kept and 3 not in kept and 1 in kept and None in kept and sum(i in kept for i in (6, 7, 8)) == 1
        if name == "benchmark decontamination":
            assert len(rows) == docs.count()
        if name == "mixing sources to target weights":
            assert all(r.text for r in rows) and len(rows) > 0
    nothing = stage(spark, clash(empty, *NAMES), SF)
    assert nothing.count() == 0 and (last or nothing.columns == docs.columns)


def test_unspaced_long_texts_count_as_one_word():
    rng = random.Random(1)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400_000)).encode()
    assert len(near_copies.shingle_set(text)) == 1 and simhash.fingerprint(text) == simhash.fingerprint(b" " + text + b"\n")
    assert toxicity.features_of(text) == toxicity.features_of(text)
