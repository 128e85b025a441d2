"""Cases at the edge of what the operators promise, each against a plain version."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import chat, decontam, licenses, reshard, vectors

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_coverage(words, template, drift):
    """The best share of a template's word pairs that stand in order within ``drift`` diagonals."""
    pairs = list(zip(template, template[1:], strict=False))
    votes = [(place, at) for at in range(len(words) - 1) for place, pair in enumerate(pairs) if pair == (words[at], words[at + 1])]
    best = 0
    for first in {at - place for place, at in votes}:
        own = sorted(v for v in votes if first <= v[1] - v[0] <= first + drift)
        longest = {}
        for k, (place, at) in enumerate(own):
            longest[k] = 1 + max((longest[j] for j in range(k) if own[j][0] < place and own[j][1] < at), default=0)
        best = max([best, *longest.values()])
    return best / len(pairs)


def test_words_far_apart_are_no_license(docs):
    text = "released " + "under the " * 200 + "mit license"
    row = licenses.scan(docs((1, text, "s"))).first()
    assert row["n_words"] == 403 and row["labels"] == "" and row["score"] == 0.75


def test_spans_are_in_order_and_no_longer_than_their_template(docs):
    rnd = random.Random(9)
    base = "released under the mit license".split()
    texts = [" ".join(base)]
    for _ in range(150):
        words = list(base)
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(words))
            words[at : at + rnd.choice([0, 1, 2])] = rnd.choices(["under", "the", "mit", "x", "released"], k=rnd.randrange(3))
        texts.append(" ".join(rnd.choices(["a", "the", "under", "license"], k=3) + words + rnd.choices(["mit", "license", "the"], k=rnd.randrange(4))))
    got = {r["doc_id"]: r["score"] for r in licenses.scan(docs(*[(k, t, "s") for k, t in enumerate(texts)]), phrases=(), notices=(("mit", " ".join(base)),)).collect()}
    assert got == {k: plain_coverage(WORD.findall(t), base, licenses.DRIFT) for k, t in enumerate(texts)}
    assert len(set(got.values())) > 3


def test_directions_of_any_length(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [1e-200, -1e-200]), (5, [3.0, 3.0]), (6, [1e308, -1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (1, 4), 6: (1, 4)}


def test_a_conversation_named_none_is_not_the_nameless_one(spark):
    rows = [(None, 0, "user", "a"), ("none", 0, "user", "b"), ("", 0, "user", "c"), (None, 1, "assistant", "d")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {r["conv_id"]: r["n_turns"] for r in chat.reconstruct(chat.turn_events(df)).collect()}
    assert got == {None: 2, "none": 1, "": 1}


def test_rows_without_a_shard_move_and_other_columns_stay(spark):
    rows = [(k, k % 3 if k % 5 else None, 10 + k, k * 7, f"a{k}", k, f"s{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "id long, was int, size long, tie long, at string, group_size long, given string")
    for n in (1, 3, 6):
        got = reshard.reshard(df, F.col("was"), n).collect()
        counts = [sum(r["shard"] == j for r in got) for j in range(n)]
        assert len(got) == 40 and max(counts) - min(counts) <= 1
        for r in got:
            assert (r["at"], r["group_size"], r["given"]) == (f"a{r['id']}", r["id"], f"s{r['id']}")
            assert r["old_shard"] == (r["id"] % 3 if r["id"] % 5 else None) and r["moved"] == (r["old_shard"] != r["shard"])
        for j in range(n):
            assert sorted(r["slot"] for r in got if r["shard"] == j) == list(range(counts[j]))
    assert reshard.reshard(df.limit(0), F.col("was"), 3).count() == 0


def test_small_and_nameless_items_are_found(spark, docs):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    items = {k: " ".join(word() for _ in range(n)) for k, n in enumerate([1, 2, 4, 5, 6, 7, 8, 9, 11, 12, 13, 30])}
    items[None] = " ".join(word() for _ in range(12))
    rows, want = [], set()
    for k, (name, text) in enumerate(items.items()):
        for spot in (0, 700):
            filler = [word() for _ in range(1400)]
            doc = 10 * k + (spot > 0)
            # Places around the item stay apart from it by whole sequences only where it has five words.
            rows.append((doc, " ".join(filler[:spot] + text.split() + filler[spot:]) if len(text.split()) > 4 else text, "s"))
            want.add((doc, name))
    rows.append((900, " ".join(word() for _ in range(3000)), "s"))
    df = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contained(docs(*rows), df).collect()}
    assert got == want


def test_parts_of_small_items_down_to_the_threshold(spark, docs):
    """Items of five to eight shingles of which a text holds some: exact, as in the plain version."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    items = [[word() for _ in range(n)] for n in (9, 10, 11, 12)]
    rows = []
    for words in items:
        for cut in range(4):
            for side in (words[cut:], words[: len(words) - cut]):
                rows.append((len(rows), " ".join([word() for _ in range(50)] + side + [word() for _ in range(50)]), "s"))
    five = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = {(d, k) for d, t, _ in rows for k, w in enumerate(items) if len(five(w) & five(t.split())) / len(five(w)) >= 0.8}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contained(docs(*rows), df).collect()} == want
    assert 0 < len(want) < len(rows)


def test_recall_with_long_bucket_keys(spark):
    """Enough vectors and small buckets for keys of ten bits and more: links at the threshold are still found."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((1500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turn = rng.standard_normal(base.shape)
    turn -= (turn * base).sum(axis=1, keepdims=True) * base
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    cosine = rng.uniform(0.901, 0.93, (1500, 1))
    both = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * turn])
    bits, tables = vectors.plan(len(both), bucket=2)
    assert bits >= 10 and tables >= 20
    df = spark.createDataFrame(list(enumerate(both.tolist())), "vec_id long, embedding array<double>").repartition(4)
    got = vectors.near_duplicates(df, bucket=2).agg(F.sum("n_links")).first()[0]
    units = both / np.linalg.norm(both, axis=1, keepdims=True)
    want = int((units @ units.T >= 0.9).sum()) - len(units)
    assert want >= 3000 and got <= want and got >= 0.98 * want


def test_blocks_are_permuted_and_not_turned(spark):
    from ledgerline.llm import mixing

    sizes = [1, 2, 3, 4, 5, 6, 7, 9, 10, 15, 16, 17, 150, 330, 1000, 1321]
    df = spark.createDataFrame([(n, b) for n in sizes for b in range(n)], "n long, b long")
    draws = [F.expr(mixing.permuted("b", "n", str(key), 5)).alias(f"k{key}") for key in (1, 2)]
    got = {}
    for r in df.select("n", "b", *draws).orderBy("n", "b").collect():
        got.setdefault(r["n"], []).append((r["k1"], r["k2"]))
    for n, pairs in got.items():
        for order in zip(*pairs, strict=True):
            assert sorted(order) == list(range(n))
            if n >= 150:  # neighbours are neither one step apart nor in any other fixed step
                steps = [(b - a) % n for a, b in zip(order, order[1:], strict=False)]
                assert max(steps.count(s) for s in set(steps)) < n / 8
        if n >= 9:
            assert [a for a, _ in pairs] != [b for _, b in pairs]


def test_affected_files_are_rewritten_and_read_back(spark, docs, tmp_path):
    rows = docs(*[(k if k % 9 else None, f"text {k}" if k % 7 else None, "abc"[k % 3]) for k in range(60)])
    was = F.ascii("source") - 97
    for n, folder in ((8, "a"), (3, "b")):
        got = reshard.rewritten(rows, was, n, f"file://{tmp_path}/{folder}").collect()
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(r["doc_id"]), str(r["text"])) for r in rows.collect())
        files = {p.name for p in (tmp_path / folder).glob("shard=*")} if (tmp_path / folder).exists() else set()
        moved = {f"shard={x}" for r in got if r["moved"] for x in (r["old_shard"], r["shard"]) if x < n}
        assert moved <= files
        for j in range(n):
            own = sorted((r for r in got if r["shard"] == j), key=lambda r: r["slot"])
            assert [r["slot"] for r in own] == list(range(len(own)))
        assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in got)
    assert reshard.rewritten(rows.limit(0), was, 3, f"file://{tmp_path}/none").count() == 0
