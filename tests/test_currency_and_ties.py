"""A filing's own currency, and a total order where two facts tie."""

import datetime as dt

from ledgerline.functions import concepts as C
from ledgerline.operators import periods as pr
from ledgerline.operators import resolve as rs
from ledgerline.plans import fundamentals as plan


def test_history_stays_in_the_currency_of_the_filing(spark):
    day = lambda y, m, d: dt.date(y, m, d)
    rows = []
    for concept, unit, value in (
        ("Revenues", "EUR", 100.0), ("Revenues", "USD", 110.0), ("NetIncomeLoss", "EUR", 20.0), ("Assets", "EUR", 500.0), ("CostOfRevenue", "EUR", 60.0),
    ):
        start = None if concept == "Assets" else day(2020, 1, 1)
        rows.append((9, "us-gaap", concept, unit, start, day(2020, 12, 31), day(2021, 2, 1), "a-1", 2020, "FY", "10-K", value, None))
    facts = spark.createDataFrame(
        rows, "cik long, taxonomy string, concept string, units string, start_date date, end_date date, filed date, accn string, "
              "fy int, fp string, form string, value double, dimension string",
    )
    r = plan.historical_extract(facts, {"10-K": 3}, 4).first()
    assert (r["revenue"], r["net_income"], r["net_margin"]) == (100.0, 20.0, 0.2)


def filed(spark, rows):
    made = [(cik, "us-gaap", concept, unit, dt.date(2020, 1, 1), dt.date(2020, 12, 31), dt.date(2021, 2, 1), f"a-{cik}", 2020, "FY", "10-K", value, None)
            for cik, concept, unit, value in rows]
    return spark.createDataFrame(
        made, "cik long, taxonomy string, concept string, units string, start_date date, end_date date, filed date, accn string, "
              "fy int, fp string, form string, value double, dimension string")


def test_a_dollar_filing_drops_rows_in_other_currencies(spark):
    """Either way round the currency of most rows is kept, and the smaller amount of the other one does not win."""
    for own, other in (("USD", "EUR"), ("EUR", "USD")):
        rows = [(7, "Revenues", own, 100.0), (7, "Revenues", other, 90.0), (7, "NetIncomeLoss", own, 20.0), (7, "CostOfRevenue", own, 60.0)]
        r = plan.historical_extract(filed(spark, rows), {"10-K": 3}, 4).first()
        assert (r["revenue"], r["net_margin"]) == (100.0, 0.2)


def test_history_holds_every_metric_of_the_rules(spark):
    tags = {}
    for rule in C.default_rules():
        if rule.industry in ("*", "standard") and not rule.aggregate:
            tags.setdefault(rule.metric, rule.tag)
    value = {t: 1000.0 + k for k, t in enumerate(dict.fromkeys(tags.values()))}
    facts = filed(spark, [(3, t, "USD", v) for t, v in value.items()])
    long = {r["metric"]: r["value"] for r in plan.historical_metrics(facts, {"10-K": 3}, 4).collect()}
    assert len(rs.ALL_METRICS) == 79 and set(tags) <= set(long)
    wide = plan.historical_extract(facts, {"10-K": 3}, 4)
    assert set(rs.ALL_METRICS) | set(rs.DERIVED_METRICS) <= set(wide.columns)
    r = wide.first()
    derived = {"gross_profit", "capital_expenditures", "depreciation_amortization", "revenue"}
    assert {m: r[m] for m in long if m not in derived} == {m: v for m, v in long.items() if m not in derived}


def test_prefixed_tags_that_tie_are_ordered_by_value(spark):
    rows = [(1, "2020-12-31", "a:NetIncomeLoss", v) for v in (7.0, 3.0)] + [(1, "2020-12-31", "b:NetIncomeLoss", 5.0)]
    for order in (rows, rows[::-1]):
        facts = spark.createDataFrame(order, "cik long, end_date string, concept string, value double")
        got = rs.resolve_metrics(facts, metrics=["net_income"]).collect()
        assert [r["value"] for r in got] == [3.0]


def test_periods_that_tie_come_in_one_order(spark):
    rows = [(1, 2020, 2, True, dt.date(2020, 6, 30), v, "standalone") for v in (30.0, 10.0, 20.0)] + [(1, 2020, 1, False, dt.date(2020, 3, 31), 4.0, "standalone")]
    seen = set()
    for k in range(3):
        df = spark.createDataFrame(rows[k:] + rows[:k], "cik long, fy int, rank int, is_ytd boolean, end_date date, revenue double, quality string").repartition(3)
        seen.add((
            tuple(r["revenue"] for r in pr.newest(df, 2).orderBy("n").collect()), tuple(r["revenue"] for r in pr.newest_summable(df, 2).orderBy("n").collect()),
            tuple(sorted((r["rank"], r["revenue"]) for r in pr.decumulate(df.drop("quality")).collect())),
        ))
    assert len(seen) == 1 and next(iter(seen))[0] == (10.0, 20.0)
