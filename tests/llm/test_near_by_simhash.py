"""The pipeline's near-duplicate stage runs the fingerprint method; its links are verified like all others."""

import corpus_pipeline as pipeline
from ledgerline.llm import simhash


def test_stage_takes_links_from_the_fingerprints(spark, docs, monkeypatch):
    calls = []
    real = simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a, **k: calls.append(k) or real(*a, **k))
    text = " ".join(f"w{i}" for i in range(60))
    rows = docs((1, text, "a"), (2, text + " end", "a"), (3, "other words that stand alone here", "b"), (None, text, "c"), (4, None, "d"), (5, "", "d"))
    got = pipeline.near_copies_out(spark, rows, "")
    assert len(calls) == 1
    assert {r["doc_id"] for r in got.collect()} == {1, 3, 4}


def test_groups_found_otherwise_are_verified(spark, docs):
    text = " ".join(f"w{i}" for i in range(60))
    rows = docs((1, text, "a"), (2, text + " end", "a"), (3, "other words that stand alone here", "b"), (4, "", "c"))
    near = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4)], "doc_id long, component_id long")
    # Without any band of minima the given groups alone make links.
    alone = simhash.similar_groups(rows, near=near)
    assert {(r["doc_id"], r["component_id"]) for r in alone.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
