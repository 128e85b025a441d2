"""Components and SimHash groups against plain versions."""

import random

import numpy as np
import pytest
import xxhash

from ledgerline.llm import simhash
from ledgerline.llm.components import components


def plain_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def plain_fingerprint(text, words=3):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    width = min(words, len(tokens))
    hashes = [xxhash.xxh64_intdigest(b" ".join(tokens[i : i + width]), 42) for i in range(len(tokens) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_paths_stars_and_random_graphs(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    edges += [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)] + [(7, 7), (7, 8)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    want = plain_components([e for e in edges if e[0] != e[1]])
    assert got == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_fingerprint_is_the_stated_one():
    for text in (None, "", " \t", "One", "A b", "A b\x0bc D", "ä Ä ß x", "w " * 40_000 + "end", "a b c a b c a b c"):
        assert simhash.fingerprint(text, 3) & (1 << 64) - 1 == plain_fingerprint(text)


def test_embedding_bounds_the_distance(spark):
    rnd = random.Random(5)
    rows = [(rnd.getrandbits(64) - (1 << 63), rnd.getrandbits(64) - (1 << 63)) for _ in range(50)]
    df = spark.createDataFrame(rows, "a long, b long")
    from pyspark.sql import functions as F

    out = df.select("a", "b", F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b")))).alias("d"))
    for a, b, d in out.collect():
        counts = [abs(bin(a >> 2 * i & 3).count("1") - bin(b >> 2 * i & 3).count("1")) for i in range(32)]
        assert d == sum(counts) <= bin((a ^ b) & (1 << 64) - 1).count("1")


@pytest.mark.parametrize("crowded", [64, 1])
def test_links_connect_all_in_reach(spark, crowded):
    rnd = random.Random(1)
    values = {rnd.getrandbits(64)}
    for _ in range(150):
        x = rnd.choice(sorted(values))
        for _ in range(rnd.choice([1, 2, 3])):
            x ^= 1 << rnd.randrange(64)
        values.add(x)
    values |= {rnd.getrandbits(64) for _ in range(50)}
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = [(a, b) for a in values for b in values if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), crowded=crowded).collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in got)
    assert plain_components(got) == plain_components(edges)


def test_near_duplicates_with_nulls_repeats_and_empty_texts(spark, docs):
    long = "some words that are said over and over again until nobody listens any more to them at all "
    rows = [(5, long * 30, "a"), (3, long * 30, "a"), (3, long * 30, "a"), (9, None, "b"), (8, "", "b"), (None, "  ", None),
            (None, "lonely text here now", "c"), (1, "another text with words", "c"), (2, long.upper() * 30, "a")]
    got = sorted(map(tuple, simhash.near_duplicates(docs(*rows)).collect()), key=str)
    fp = lambda t: f"{plain_fingerprint(t):016x}"
    same = fp(long * 30)
    want = [(5, same, 2), (3, same, 2), (3, same, 2), (9, "0" * 16, 8), (8, "0" * 16, 8), (None, "0" * 16, 8),
            (None, fp("lonely text here now"), None), (1, fp("another text with words"), 1), (2, same, 2)]
    assert got == sorted(want, key=str)
    assert simhash.near_duplicates(docs().limit(0)).collect() == []


def test_similar_groups(spark, docs):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    rows, want = [], {}
    for g in range(12):
        words = [word() for _ in range(400)]
        for k in range(3):
            copy = list(words)
            for _ in range(2 * k):
                copy[rnd.randrange(400)] = word()
            rows.append((10 * g + k, " ".join(copy), "s"))
            want[10 * g + k] = 10 * g
    rows += [(500, None, "s"), (501, "", "s")]
    want |= {500: 500, 501: 500}
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs(*rows)).collect()} == want
    blocks = simhash.similar_groups(docs(*rows), bucket=8)
    assert {r["doc_id"]: r["component_id"] for r in blocks.collect()} == want


def test_similar_groups_link_what_is_alike_and_nothing_else(spark, docs):
    """Families of texts that share much of a long passage, around 0.8 from both sides, against brute force."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    rows = []
    for size in (6, 12, 30, 60, 150, 400):
        for _ in range(6):
            base = [word() for _ in range(size)]
            for _ in range(7):
                cut = rnd.randrange(0, max(2, size * 3 // 10))
                rows.append((len(rows), " ".join(base[: size - cut] + [word() for _ in range(rnd.choice([0, cut // 2, cut]))]), "s"))
    sets = {}
    for i, t, _ in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = 0
    for a in sets:
        for b in range(a):
            alike = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            near += 0.6 <= alike < 0.8
            if alike >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert near > 100 and len({find(x) for x in sets}) > 60
    for bucket in (2048, 3):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs(*rows), bucket=bucket).collect()}
        assert got == {i: find(i) for i in sets}


def test_reach_and_bands_hold_the_pairs_at_the_threshold():
    rnd = np.random.default_rng(3)
    bands, width = simhash.banding(0.8, 1 - 1e-5)
    lost, radius, apart = 0, simhash.reach(0.8), []
    for k in range(600):
        n = [1, 5, 40][k % 3]
        x = rnd.integers(0, 1 << 63, 10 * n, dtype=np.uint64)
        low = [simhash.minima(x[: 9 * n]), simhash.minima(x[n:])]  # 8 of 10 in common
        cells = [simhash._cell_keys(v, bands, width) for v in low]
        apart.append(int(np.bitwise_count((simhash._bits(low[0]) ^ simhash._bits(low[1])).view(np.uint64)).sum()))
        lost += not (cells[0] == cells[1]).any() or apart[-1] > radius
    assert lost == 0 and abs(np.mean(apart) - 25.6) < 1
