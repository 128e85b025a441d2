"""License scan, toxicity, decontamination and repeats on hand-made rows."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from ledgerline.llm import decontam, licenses, repeats, toxicity
from ledgerline.llm.common import runs


def test_runs_cut_groups_across_batches():
    frames = [pd.DataFrame({"k": list(k)}) for k in ("aab", "", "bbc", "c", "d")]
    assert ["".join(g["k"]) for g in runs(frames, ["k"])] == ["aa", "bbb", "cc", "d"]


def test_license_scan(spark, docs):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a really big copy of this software and "
           "associated documentation files")
    rows = [(1, "CC-BY cc by, and cc  by", "a"), (2, "the GNU General Public License. All rights reserved", "a"), (3, None, "a"),
            (4, "", "a"), (5, "general public\nlicense general", "a"), (6, mit, "a"), (7, "word", "a"), (7, "word", "a"),
            (None, "all rights  RESERVED all rights", None), (8, "permission is hereby granted to leave", "a")]
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(docs(*rows)).collect()}
    assert licenses.scan(docs(*rows)).count() == len(rows)
    r = got[1, 7]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == (3, 0, 5, "cc-by", "cc-by", 1.0)
    assert got[2, 8]["base_labels"] == "gpl,reserved" and got[2, 8]["first_word"] == 2
    assert (got[3, 0]["n_base"], got[3, 0]["first_word"], got[3, 0]["labels"], got[3, 0]["score"]) == (0, None, "", 0.0)
    assert got[5, 4]["n_base"] == 1
    r = next(v for k, v in got.items() if k[0] == 6)
    assert r["labels"] == "mit" and r["base_labels"] == "" and 0.8 <= r["score"] < 1
    assert got[None, 5]["n_base"] == 1 and got[8, 6]["labels"] == ""
    assert licenses.scan(docs().limit(0)).collect() == []
    plan = licenses.scan(docs(*rows))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_license_phrases_in_a_very_long_text(spark, docs):
    text = "cc by " * 20_000 + "filler " * 100_000 + "general public license"
    r = licenses.scan(docs((1, text, "a"))).first()
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (20_001, 0, 140_000, "cc-by,gpl")


def made_texts(n, seed=0):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("aeioulmnrst", k=rnd.randint(2, 7)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(30, 120))]
        bad = i % 6 == 0
        if bad:
            for _ in range(4):
                words[rnd.randrange(len(words))] = rnd.choice(["vexgrub", "dolthead", "knavish"])
        rows.append((i, " ".join(words), "s", bad))
    return rows


def test_toxicity_learns_from_positives_and_unlabelled(spark, docs):
    rows = made_texts(900)
    labels = spark.createDataFrame([(i, int(bad)) for i, _, _, bad in rows if i % 2 == 0], "doc_id long, toxic int")
    table = docs(*[r[:3] for r in rows], (None, "a text", "s"), (5000, None, "s"), (5001, "", "s"))
    got = toxicity.score(table, labels).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got)
    bad = {r[0]: r[3] for r in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in bad]
    assert 100 < len(held) < 260
    assert sum(r["predicted"] == bad[r["doc_id"]] for r in held) >= 0.95 * len(held)
    again = toxicity.score(table, labels).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in again) == sorted((str(r["doc_id"]), r["score"]) for r in got)


def test_toxicity_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(docs((1, "x", "s")), none).collect()] == [0.0]
    some = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.score(docs((1, "x", "s")), some).collect()] == [0]
    assert toxicity.score(docs().limit(0), none).collect() == []


def test_risk_is_kept_non_negative():
    rnd = random.Random(0)
    good = [" ".join(rnd.choices(["alpha", "beta", "gamma", "delta"], k=20)) for _ in range(300)]
    bad = [t + " vexgrub dolthead" for t in good[:60]]
    slots, weights, bias = toxicity.train(pd.Series(bad[:40]), pd.Series(good[60:] + bad[40:]), 0.08)
    z = lambda t: weights[np.isin(slots, np.unique(toxicity.grams(t)))].sum() + bias
    assert min(z(t) for t in bad[40:]) > 0 > max(z(t) for t in good)


def containment(doc, item):
    words = lambda t: re.findall(decontam.WORDLIKE, (t or "").lower())
    def parts(w):
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    a, b = parts(words(doc)), parts(words(item))
    return len(a & b) / len(b) if b else 0


def test_containment_against_brute_force(spark, docs):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefg", k=4))
    items = [(i, " ".join(word() for _ in range(rnd.randint(1, 70)))) for i in range(40)] + [(90, None), (91, ""), (92, "one two")]
    rows = [(900, None, "s"), (901, "", "s"), (902, "One, two!", "s"), (903, "one two three four five six", "s"), (None, items[3][1], None)]
    for i in range(60):
        words = [word() for _ in range(rnd.choice([0, 5, 300, 3000]))]
        own = items[i % 40][1].split()
        if i % 3 == 0:
            words[5:5] = own
        elif i % 3 == 1:  # two halves far apart
            words = own[: len(own) // 2] + words + own[len(own) // 2 :]
        rows.append((i, " ".join(words).title(), "s"))
    rows.append(rows[10])
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontam.contained(docs(*rows), tests).collect()}
    want = {(d, i): c for d, t, _ in rows for i, x in items if (c := containment(t, x)) >= 0.8}
    assert got == pytest.approx(want) and len(want) > 25
    assert decontam.contained(docs().limit(0), tests).collect() == []
    assert decontam.contained(docs(*rows), tests.limit(0)).collect() == []


def test_items_in_several_passes(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS", 2)
    items = [(i, f"item number {i} has these words of its own {i}{i} and ends") for i in range(7)]
    rows = [(i, f"before it {items[i][1]} and after it", "s") for i in range(7)]
    got = decontam.contained(docs(*rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r[0], r[1]) for r in got if r[0] == r[1]) == [(i, i) for i in range(7)]


def brute_windows(strings, length):
    seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    return [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in strings]


def test_expansion_on_the_transform():
    rnd = random.Random(1)
    for _ in range(120):
        length = rnd.choice([2, 3, 5, 8])
        letters = rnd.choice([b"a", b"ab", b"abcd", bytes(range(256))])
        strings = [bytes(rnd.choices(letters, k=rnd.randint(0, 40))) for _ in range(rnd.randint(1, 6))]
        strings.append(strings[0] + b"x" + strings[-1])
        assert [x.tolist() for x in repeats.repeated_windows(strings, length)] == brute_windows(strings, length)


@pytest.mark.parametrize("crowded", [2048, 1])
def test_repeats_against_brute_force(spark, docs, crowded):
    rnd = random.Random(6)
    line = "".join(rnd.choices("abcdefghij ", k=70))
    body = lambda n: "".join(rnd.choices("abcdéfghij ", k=n))
    rows = [(1, None, "s"), (2, "", "s"), (3, "short", "s"), (4, "z" * 130, "s"), (5, "xy" * 90, "s"), (6, body(400), "s")]
    rows += [(10 + i, body(rnd.randint(0, 120)) + line + body(rnd.randint(0, 120)), "s") for i in range(25)]
    rows += [(40, rows[8][1], "s"), (41, rows[9][1] + "!" + rows[10][1], "s"), (None, rows[11][1], None), (6, rows[5][1], "s")]
    length, gram = 40, 10
    got = repeats.remove_repeats(docs(*rows), length, gram, crowded).collect()
    data = [(t or "").encode() for _, t, _ in rows]
    want = []
    for (i, _, _), d, hits in zip(rows, data, brute_windows(data, length), strict=True):
        gone = np.zeros(len(d), bool)
        for h in hits:
            gone[h : h + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(d), int(gone.sum()), spans, kept))
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got), key=str) == sorted(want, key=str)
    assert repeats.remove_repeats(docs().limit(0)).collect() == []


def test_texts_longer_than_a_piece(spark, docs, monkeypatch):
    monkeypatch.setattr(repeats, "_CHUNK", 300)
    rnd = random.Random(8)
    text = "".join(rnd.choices("abcdefgh", k=2000))
    found = repeats.window_runs([text.encode()], 40, 10)
    assert found[2].sum() == 1961
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs((1, text, "s"), (2, "Q" + text[100:1900], "s")), 40, 10).collect()}
    assert got == {1: 1800, 2: 1800}
