"""The filing history holds every periodic filing; a cap is the caller's choice."""

import datetime as dt
import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from ledgerline.catalog import sources
from ledgerline.operators import facts as fx
from ledgerline.operators.screen import capped_filings
from ledgerline.plans import fundamentals as plan

SCHEMA = ("cik long, taxonomy string, concept string, units string, start_date date, end_date date, filed date, accn string, "
          "fy int, fp string, form string, value double, dimension string")


def history(spark, years=range(2008, 2020)):
    """Twelve years of one company: an annual and three quarterly filings each, the value of which tells them apart."""
    rows = []
    for y in years:
        for q, (month, day) in enumerate(((3, 31), (6, 30), (9, 30), (12, 31)), 1):
            end = dt.date(y, month, day)
            form, fp = ("10-K", "FY") if q == 4 else ("10-Q", f"Q{q}")
            for concept, start, value in (("Revenues", dt.date(y, 1, 1), y * 10.0 + q), ("Assets", None, y * 100.0 + q)):
                rows.append((7, "us-gaap", concept, "USD", start, end, end + dt.timedelta(40), f"{y}-{q}", y, fp, form, value, None))
    return spark.createDataFrame(rows, SCHEMA)


def test_the_query_extracts_every_periodic_filing(spark):
    got = {r["accn"]: (r["form"], r["revenue"], r["total_assets"]) for r in sources.historical_extract(SimpleNamespace(fx_facts=history(spark))).collect()}
    assert got == {f"{y}-{q}": ("10-K" if q == 4 else "10-Q", y * 10.0 + q, y * 100.0 + q) for y in range(2008, 2020) for q in (1, 2, 3, 4)}


def test_a_cap_holds_only_for_the_forms_that_have_one(spark):
    facts = history(spark)
    count = lambda *caps: {r["form"]: r["count"] for r in plan.historical_extract(facts, *caps).groupBy("form").count().collect()}
    assert count({"10-K": 3}, 4) == {"10-K": 3, "10-Q": 4}
    assert count({"10-K": 3}) == {"10-K": 3, "10-Q": 36}
    assert count({"10-K": None}, 4) == {"10-K": 12, "10-Q": 4}


def test_filings_without_a_cap_are_all_listed(spark):
    rows = [(1, form, f"{form}-{k}", dt.date(2020, 1, 1 + k) if k else None) for form in ("10-K", "10-Q", None) for k in range(6)]
    filings = spark.createDataFrame(rows, "cik long, form string, accn string, filed date")
    listed = lambda *caps: {(r["form"], r["accn"]) for r in capped_filings(filings, *caps).collect()}
    every = {r[1:3] for r in rows}
    assert listed({}) == listed({"10-K": None}) == every
    assert listed({"10-K": 2}) == {r for r in every if r[0] != "10-K"} | {("10-K", "10-K-5"), ("10-K", "10-K-4")}


def test_annual_and_interim_rows_in_one_pass_are_those_of_two(spark):
    pick, series = random.Random(3), ("cik", "concept", "units")
    day = dt.date(2020, 12, 31)
    rows = {(pick.randint(1, 4), pick.choice("abc"), pick.choice(["USD", None]), pick.choice([None, *[day - dt.timedelta(n) for n in (20, 89, 181, 272, 300, 364)]]),
             day - dt.timedelta(pick.choice([0, 365])), pick.choice(["10-K", "10-Q"])) for _ in range(400)}
    df = spark.createDataFrame(list(rows), "cik long, concept string, units string, start_date date, end_date date, form string")
    annual = F.col("form") == "10-K"
    two = fx.annual_facts(df.where(annual), series).unionByName(fx.ytd_facts(df.where(~annual), series))
    one = fx.ytd_facts(fx.annual_facts(df, series, among=annual), series, among=~annual)
    assert one.columns == two.columns
    key = lambda r: tuple(map(str, r))
    got, want = (sorted(x.collect(), key=key) for x in (one, two))
    assert got == want and len(want) < len(rows)


def test_rows_of_a_filing_are_dealt_once(spark):
    """From the join to the view, windows find their rows where the join by filing left them, whichever way it joins."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1")):
            spark.conf.set(k, v)
        facts = history(spark)
        index, view = plan.filing_views(facts, {})
        dealt = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        # The rows are dealt, and the index once more than by itself.
        assert dealt(view) <= dealt(index) + 2
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
