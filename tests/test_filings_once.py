"""Filing histories read their facts once for the index and once for the rows."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerline.operators import facts as fx
from ledgerline.plans import fundamentals as plan


def test_currency_as_a_column_is_the_detected_one(spark):
    units = {
        1: ["USD", "EUR", "EUR", "shares"], 2: ["USD", "EUR"], 3: ["iso4217:USD", "iso4217:EUR", "iso4217:EUR", "EUR/shares"],
        4: ["iso4217:JPY", "iso4217:JPY", "EUR"], 5: ["shares", None], 6: [None], 7: ["iso4217:CHF", "isoiso4217:4217:CHF", "iso4217:EUR"], None: ["EUR"],
    }
    rows = spark.createDataFrame([(k, u) for k, us in units.items() for u in us], "cik int, units string")
    want = {r["cik"]: r["currency"] for r in fx.detect_currency(rows).collect()}
    got = fx.with_currency(rows, ["cik"])
    assert got.columns == ["cik", "units", "currency"] and got.count() == rows.count()
    assert {r["cik"]: {r["c"][k] for k in range(len(r["c"]))} for r in got.groupBy("cik").agg(F.collect_list("currency").alias("c")).collect()} == {k: {v} for k, v in want.items()}


def test_rows_of_a_filing_are_not_joined_with_their_own_currency(spark):
    day = dt.date(2020, 12, 31)
    rows = [(1, "us-gaap", "Assets", u, None, day, dt.date(2021, 2, 1), "a-1", 2020, "FY", "10-K", v, None) for u, v in (("EUR", 1.0), ("USD", 2.0), ("EUR", 3.0))]
    facts = spark.createDataFrame(
        rows, "cik long, taxonomy string, concept string, units string, start_date date, end_date date, filed date, accn string, "
              "fy int, fp string, form string, value double, dimension string")
    _, view = plan.filing_views(facts, {"10-K": 3}, 4)
    # One join with the index each for annual and for interim filings.
    assert view._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") <= 2
    assert [r["value"] for r in view.collect()] == [3.0]
