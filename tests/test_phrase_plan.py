"""Phrase search never sends the pieces of the texts to every task."""

import pytest

from ledgerline.operators import text as tx


@pytest.mark.parametrize("rows", [200_000, 0])
@pytest.mark.parametrize("needles", [200, 1])
def test_texts_are_never_broadcast(spark, monkeypatch, tmp_path, rows, needles):
    monkeypatch.setattr(tx, "_BROADCAST_ROWS", rows, raising=False)
    monkeypatch.setattr(tx, "_NEEDLES", needles, raising=False)
    texts = [(n, f"the the quick brown fox {n} of the lot") for n in range(50)] + [(None, "the fox"), (60, None), (61, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    phrases = [(1, "he"), (2, "quick"), (3, "k bro"), (4, "the "), (5, "eh"), (6, "e l"), (7, "lot"), (8, "f the")]
    found = tx.phrase_search(docs, spark.createDataFrame(phrases, "item_id long, phrase string"))
    tree = found._jdf.queryExecution().executedPlan()
    assert "BuildLeft" not in tree.toString() and "NestedLoop" not in tree.toString()
    want = {(i, j) for i, t in texts if t for j, p in phrases if p in t}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_part_is_found_once_in_a_name(spark):
    names = spark.createDataFrame([("anana",), ("",), (None,), ("né é",)], "name string")
    parts = spark.createDataFrame([("an",), ("a",), ("nana",), ("",), ("é",), ("é é",), ("ananas",)], "part string")
    got = sorted(tuple(r) for r in tx.containing(names, "name", parts, "part").collect())
    assert got == [("anana", "a"), ("anana", "an"), ("anana", "nana"), ("né é", "é"), ("né é", "é é")]
