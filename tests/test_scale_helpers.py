"""Ranks, neighbours and range joins on skewed groups, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import ranking as rk
from ledgerline.operators.entities import find_comps
from ledgerline.operators.ranges import window_join
from ledgerline.session import ensure_checkpoint_dir


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    rows = [("hot" if n % 3 else f"g{n % 40}", f"T{n:05d}", None if n % 11 == 0 else float(rnd.randrange(60))) for n in range(3000)]
    return rows, spark.createDataFrame(rows, "g string, ticker string, value double")


def test_rank_matches_sorting(skewed):
    rows, df = skewed
    got = {r.ticker: (r.rank, r.group_size) for r in rk.metric_ranks(df, ["g"]).collect()}
    groups = {}
    for g, t, v in rows:
        groups.setdefault(g, []).append((v is None, -(v or 0), t))
    for items in groups.values():
        for n, item in enumerate(sorted(items), 1):
            assert got[item[2]] == (n, len(items))


def test_hot_group_spans_partitions(spark, skewed):
    _, df = skewed
    ranked = rk.rank_within(df.where("g = 'hot'"), ["g"], [F.col("value").desc_nulls_last(), F.col("ticker")])
    assert ranked.select("rank").distinct().count() == ranked.count()


def test_pages_cover_everything(skewed):
    _, df = skewed
    seen = []
    for n in (1, 2, 30):
        part = rk.page(df, [F.col("ticker")], n, 100).collect()
        assert all(r.total_pages == 30 for r in part)
        seen += [r.ticker for r in part]
    assert len(set(seen)) == 300


def test_window_join_matches_brute_force(spark):
    rnd = random.Random(5)
    left = [(n, rnd.choice("ab"), rnd.randrange(-50, 300)) for n in range(200)]
    right = [(rnd.choice("ab"), rnd.randrange(-50, 300), n) for n in range(200)]
    a = spark.createDataFrame(left, "id int, k string, x int")
    b = spark.createDataFrame(right, "k string, y int, rid int")
    got = window_join(a, b, ["k"], F.col("x") - 7, F.col("x") + 5, F.col("y"), 13, left_key=["id"]).collect()
    want = {(i, r) for i, k, x in left for k2, y, r in right if k == k2 and x - 7 <= y <= x + 5}
    assert {(r.id, r.rid) for r in got if r.rid is not None} == want
    assert {r.id for r in got if r.rid is None} == {n for n, _, _ in left} - {i for i, _ in want}


def test_comps_match_brute_force(spark):
    rnd = random.Random(9)
    rows = [("hot" if n % 3 else "cold", f"T{n:03d}", None if n % 17 == 0 else round(10 ** rnd.uniform(0, 6), 3)) for n in range(300)]
    got = {}
    for r in find_comps(spark.createDataFrame(rows, "sector string, ticker string, revenue double")).collect():
        got.setdefault(r.ticker, []).append((r.n, r.peer))
    by_sector = {}
    for s, t, v in rows:
        by_sector.setdefault(s, []).append((t, v))
    for s, t, v in rows:
        if v is None:
            continue
        pool = []
        for p, w in by_sector[s]:
            if p != t:
                d = 1000.0 if w is None else max(w / v, v / w)
                pool.append((d, p, w is None or v * 0.2 <= w <= v * 5.0))
        scored = [x for x in pool if x[2]]
        use = scored if len(scored) >= 3 else pool
        assert [p for _, p in sorted(got[t])] == [p for _, p, _ in sorted(use)[:5]], t


def test_checkpoint_folder_comes_from_the_session(spark):
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()
