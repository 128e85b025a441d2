"""The pipeline's stages against plain versions of what each has to do."""

import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def five(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in pipeline.STAGES:
        docs = pipeline.written(stage(spark, docs, SF))
        out.append((docs.columns, docs.collect()))
    return [(["doc_id", "text", "lang", "source", "n_chars"], out[0]), *out[1:]]


def test_order_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "mixing", "sharding"]
    for columns, _ in stages[:-1]:
        assert columns == pipeline.COLUMNS


def test_filters_only_take_rows_away(stages):
    for (_, before), (_, after) in zip(stages[:3], stages[1:4], strict=True):
        assert not Counter(map(tuple, after)) - Counter(map(tuple, before))


def test_one_of_each_group_stays(stages):
    """Components of all pairs with a Jaccard index of 0.8 or more, by brute force: the smallest id of each stays."""
    before, after = stages[1][1], stages[2][1]
    sets = {r["doc_id"]: five(r["text"]) for r in before}
    assert len(sets) == len(before)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"] for r in after} == {d for d in sets if find(d) == d}


def test_leaks_go_and_others_stay(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    def words(text):
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()
    tests = [w for w in map(words, items) if w]
    leak = lambda text: any(len(words(text) & t) >= 0.8 * len(t) for t in tests)
    want = {r["doc_id"] for r in stages[2][1] if not leak(r["text"])}
    assert {r["doc_id"] for r in stages[3][1]} == want


def test_mix_and_shards(stages):
    size = lambda rows, s: sum(len((r["text"] or "").split()) for r in rows if r["source"] == s)
    before, after, last = stages[3][1], stages[4][1], stages[5][1]
    total = sum(len((r["text"] or "").split()) for r in before)
    assert abs(sum(len(r["text"].split()) for r in after) - 1.5 * total) < 0.03 * total
    for s in {r["source"] for r in before}:
        assert size(after, s) <= 2 * size(before, s)
    assert Counter((r["doc_id"], r["text"]) for r in after) == Counter((r["doc_id"], r["text"]) for r in last)
    counts = Counter(r["shard"] for r in last)
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 1


def test_nulls_empty_tables_and_clashing_columns(spark, docs):
    rows = docs((1, None, "a"), (1, None, "a"), (None, "", None), (2, "some text of a few words only", "b"), (None, None, None),
                (3, "long " * 5000, "c"), (4, "long " * 5000, "c"))
    for given in (rows.withColumn("row", rows.doc_id), rows.limit(0)):
        got = given
        for _, stage in pipeline.STAGES:
            got = pipeline.written(stage(spark, got, SF))
        assert got.count() == 0 or {r["doc_id"] for r in got.collect()} <= {2, 3}


def test_shards_are_dealt_and_shuffled(spark, docs):
    """Every shard holds the sources in like parts, most rows stay where the mix dealt them, in shuffled order."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(320)), "abc"[i % 3]) for i in range(240)]
    taken = pipeline.written(pipeline.mixed(spark, docs(*rows), SF))
    got = pipeline.sharded(spark, taken, SF).collect()
    assert len(got) == taken.count() and len({(r["doc_id"], r["text"]) for r in got}) > 1000
    share = lambda rows, s: sum(len(r["text"].split()) for r in rows if r["source"] == s) / sum(len(r["text"].split()) for r in rows)
    runs = 0
    for k in range(8):
        own = sorted((r for r in got if r["shard"] == k), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert all(abs(share(own, s) - share(got, s)) < 0.08 for s in "abc")
        runs += sum(a["source"] != b["source"] for a, b in zip(own, own[1:], strict=False)) / len(own)
    assert runs / 8 > 0.5 and sum(r["moved"] for r in got) < 0.1 * len(got)


def test_mixing_query_tells_the_shards(spark):
    import __spark_entry__ as entry

    got = entry.queries()["op5_mixing"](spark, SF).collect()
    assert all(sum(r["shard_words"]) == r["taken"] for r in got)
    per = [sum(r["shard_words"][k] for r in got) for k in range(8)]
    assert max(per) - min(per) <= 0.02 * sum(per)
