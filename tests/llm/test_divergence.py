import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top, least):
    """The contract by nested loops, with Python's whole numbers."""
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = set()
    for lang in {g[0] for g in counts}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        groups = {s: c for (at, s), c in counts.items() if at == lang}
        whole = sum(groups.values(), Counter())

        def share(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s, mine in p.items():
            value = [(-sum((mine[t] - o[t]) ** 2 // o[t] for t in kept), other) for other, o in p.items() if other != s]
            out |= {(lang, s, "pair", i, -v, r) for r, (v, i) in enumerate(sorted(value, key=lambda x: (x[0], x[1].encode())), 1)}
            value = [(-((mine[t] - q[t]) ** 2 // q[t]), t) for t in kept if groups[s][t] and mine[t] > q[t]]
            out |= {(lang, s, "term", i, -v, r) for r, (v, i) in enumerate(sorted(value, key=lambda x: (x[0], x[1].encode())), 1) if r <= top}
    return out


def made(spark, rows):
    full = [(k, t, lang, s, "x", 0) for k, (lang, s, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, term string, value int").repartition(3)


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def words(rng, n, size):
    names = ["w" + "".join("abcdefghij"[int(c)] for c in str(k)) for k in range(size)] + ["Ärger", "naïve", "zoë", "北京"]
    return " ".join(names[min(int(k), len(names) - 1)] for k in rng.zipf(1.3, n))


def test_against_plain(spark):
    rng = np.random.default_rng(3)
    rows = [(["en", "de", None][int(rng.integers(3))], f"s{int(rng.integers(5))}" if k % 7 else None, words(rng, 60, 80)) for k in range(150)]
    rows += [("en", "s1", None), ("en", "none", ""), ("fr", "alone", "one two"), ("xx", "a", "1 2 3"), ("xx", "b", "only once")]
    rows += [("en", "hot", "Copy COPY copy ärger")] * 80
    rows += [("en", "long", "word " * 20000 + "x" * 100_000)] * 3
    for top in (200, 5):
        assert got(divergence.audit(made(spark, rows), top=top)) == plain(rows, top, 3)


def test_small_merges_and_tiles_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [("en", f"s{k % 13}", words(rng, 80, 300)) for k in range(130)]
    monkeypatch.setattr(divergence, "MERGED", 20)
    assert got(divergence.audit(made(spark, rows), top=7)) == plain(rows, 7, 3)


def test_tiles(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "_TILE", 2)
    monkeypatch.setattr(divergence, "_TILES", 2)
    totals = [50, 60, 70, 80, 90]
    terms = [[(0, 3), (4, 2)], [(1, 7)], [(0, 1), (1, 1), (2, 1), (3, 1)]]
    kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int64())]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en"] * 3), pa.array([[{"at": a, "n": n} for a, n in t] for t in terms], kind), pa.array([totals] * 3)], names=["lang", "counts", "totals"])
    sums = Counter()
    for out in divergence._pair_sums(iter([batch, batch])):
        for r in out.to_pylist():
            sums[r["i"], r["j"]] += r["value"]
    p = [[1 + 10**9 * (dict(t).get(k, 0) + 1) // totals[k] for k in range(5)] for t in terms]
    assert sums == {(i, j): 2 * sum((x[i] - x[j]) ** 2 // x[j] for x in p) for i in range(5) for j in range(5)}


def test_no_rows(spark):
    assert got(divergence.audit(made(spark, [("en", "s", "a")]).limit(0))) == set()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(0, 6)), min_size=1, max_size=300), st.integers(1, 6))
def test_skyband_counts_dominators(pairs, k):
    own = np.array([p[0] for p in pairs])
    whole = own + np.array([p[1] for p in pairs])
    name = np.random.default_rng(len(pairs)).permutation(len(pairs))
    keep = divergence.skyband(own, whole, name, k)
    over = (own[None] >= own[:, None]) & (whole[None] <= whole[:, None]) & (name[None] < name[:, None])
    assert (keep == (over.sum(axis=1) < k)).all()


def test_shares_of_great_counts(spark):
    from pyspark.sql import functions as F

    cases = [(0, 1), (10**12, 10**13), (3 * 10**12, 3 * 10**12 + 1), (5, 7)]
    want = [1 + 10**9 * (c + 1) // d for c, d in cases]
    assert divergence._shares(*(np.array(x) for x in zip(*cases, strict=True))).tolist() == want
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, c long, d long")
    assert [r[0] for r in df.orderBy("k").select(divergence.share(F.col("c"), F.col("d"))).collect()] == want
