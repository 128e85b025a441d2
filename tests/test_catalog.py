"""Every registered query against its SQL twin on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerline.plans.fixtures import BASE_TABLES
from tools.compare import canon

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert not set(ORACLES) - set(QUERIES)


def test_flagship(spark):
    df = entry.entry(spark)
    assert {"cik", "revenue", "net_margin", "roe"} <= set(df.columns)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([canon(r[c]) for c in cols]) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr([canon(r[k]) for k in at]) for r in cur.fetchall())
