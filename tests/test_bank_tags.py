"""Metrics of few tags take only those tags through the windows that select facts."""

import datetime as dt

from ledgerline.functions import concepts as C
from ledgerline.operators import facts as fx
from ledgerline.operators import resolve as rs


def test_other_tags_drop_out_before_the_windows(spark):
    day = dt.date(2020, 12, 31)
    rows = [(1, "us-gaap", c, "USD", dt.date(2020, 1, 1), day, v) for c, v in (("x:NoninterestIncome", 3.0), ("Assets", 9.0), ("InterestIncomeExpenseNet", 2.0), (None, 1.0))]
    facts = spark.createDataFrame(rows, "cik long, taxonomy string, concept string, units string, start_date date, end_date date, value double")
    # Values made by a pass over the rows, so that filters do not vanish in a local table.
    view = fx.annual_facts(facts.repartition(2, "cik"))
    rules = C.bank_driver_rules()
    got = rs.resolve_metrics(view, rules, metrics=list(dict.fromkeys(r.metric for r in rules)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Window ["):]
    assert "regexp_extract(concept" in below
    assert {(r["metric"], r["value"]) for r in got.collect()} == {("noninterest_income", 3.0), ("net_interest_income", 2.0)}
