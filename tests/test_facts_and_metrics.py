import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import concepts as C
from ledgerline.functions.dates import duration_class, market_session
from ledgerline.functions.numeric import money_text, safe_div, safe_num
from ledgerline.functions.ratios import with_ratios, with_valuation
from ledgerline.operators import facts as fx
from ledgerline.operators import resolve as rs

D = dt.date
FACT = (
    "cik long, concept string, label string, value double, start_date date, end_date date, filed date, form string, "
    "accn string, fy int, fp string, units string, taxonomy string"
)


def fact(cik, concept, value, start, end, filed=D(2024, 2, 1), accn="a", units="USD"):
    return (cik, concept, concept, value, start, end, filed, "10-K", accn, end.year, "FY", units, "us-gaap")


def year(concept, value, y=2023, cik=1, **kw):
    return fact(cik, concept, value, D(y, 1, 1), D(y, 12, 31), **kw)


def test_latest_filed_wins_and_is_idempotent(spark):
    df = spark.createDataFrame([
        year("Revenues", 100.0, filed=D(2024, 2, 1)), year("Revenues", 101.0, filed=D(2025, 2, 1)),
        fact(1, "Assets", 7.0, None, D(2023, 12, 31), filed=None), fact(1, "Assets", 8.0, None, D(2023, 12, 31)),
    ], FACT)
    once = fx.dedupe_facts(df)
    assert {(r.concept, r.value) for r in once.collect()} == {("Revenues", 101.0), ("Assets", 8.0)}
    assert fx.dedupe_facts(once).count() == 2


@pytest.mark.parametrize("days,want", [(64, "other"), (65, "Q"), (115, "Q"), (116, "other"), (205, "H"), (245, "9M"), (371, "FY"), (401, "other")])
def test_duration_bands(spark, days, want):
    df = spark.createDataFrame([(D(2023, 1, 1), D(2023, 1, 1) + dt.timedelta(days=days))], "start_date date, end_date date")
    assert df.select(duration_class()).first()[0] == want


def resolve(spark, rows, rules=None, industry=None):
    df = spark.createDataFrame(rows, FACT)
    ind = spark.createDataFrame([(1, industry)], "cik long, industry string") if industry else None
    return {r.metric: r for r in rs.resolve_metrics(df, rules, industry=ind).collect()}


def test_priority_then_custom_then_sum(spark):
    got = resolve(spark, [year("SalesRevenueNet", 5.0), year("Revenues", 9.0), year("abc_TotalRevenue", 99.0)])
    assert (got["revenue"].value, got["revenue"].method, got["revenue"].confidence) == (9.0, "exact", 0.99)
    got = resolve(spark, [year("abc_TotalRevenue", 40.0), year("xyz_Revenue", -50.0), year("abc_ForecastRevenue", 900.0)])
    # A bare "Revenue" is a rule of its own, so the prefixed tag resolves exactly.
    assert got["revenue"].method == "exact" and got["revenue"].value == -50.0
    got = resolve(spark, [year("abc_TotalRevenue", 40.0), year("xyz_TotalRevenue", -50.0)])
    assert (got["revenue"].value, got["revenue"].method) == (-50.0, "custom_ext")
    got = resolve(spark, [year("InterestIncomeExpenseNet", 6.0), year("NoninterestIncome", 3.0)], industry="bank")
    row = got["revenue"]
    assert (row.value, row.method) == (9.0, "aggregate")
    assert row.source == "Net Interest Income (alt) + Noninterest Income" and row.confidence == pytest.approx(0.70)


def test_prefixed_tag_needs_absence_of_the_bare_one(spark):
    got = resolve(spark, [year("abc:NetIncomeLoss", 3.0)])
    assert got["net_income"].value == 3.0
    rows = [year("abc:NetIncomeLoss", 3.0), year("NetIncomeLoss", 4.0, y=2022)]
    df = rs.resolve_metrics(spark.createDataFrame(rows, FACT))
    assert [(r.end_date.year, r.value) for r in df.where("metric = 'net_income'").collect()] == [(2022, 4.0)]


def test_fuzzy_rules_only_when_asked(spark):
    rules = [C.ConceptRule("goodwill", "*", 1, "Goodwill", "Goodwill", fuzzy=True)]
    got = resolve(spark, [year("SpecialGoodwillBalance", 2.0)], rules)
    assert (got["goodwill"].value, got["goodwill"].method) == (2.0, "contains")
    assert "goodwill" not in resolve(spark, [year("SpecialGoodwillBalance", 2.0)])


def test_signed_tax_in_ebitda_and_missing_stays_missing(spark):
    rows = [year("NetIncomeLoss", 10.0), year("IncomeTaxExpenseBenefit", -4.0), year("InterestExpense", -1.0),
            year("DepreciationAndAmortization", 3.0), year("DepreciationDepletionAndAmortization", 2.0)]
    row = rs.extract(fx.annual_facts(fx.clean_facts(spark.createDataFrame(rows, FACT)))).first()
    assert row.ebitda == 10 + 1 - 4 + 3 and row.depreciation_amortization == 3.0
    assert row.free_cash_flow is None and row.revenue is None


def test_two_currencies_resolve_in_one(spark):
    rows = [year("Revenues", 100.0, units="EUR"), year("NetIncomeLoss", 9.0, units="EUR"), year("Revenues", 110.0, units="USD")]
    clean = fx.clean_facts(spark.createDataFrame(rows, FACT)).collect()
    assert {(r.concept, r.value) for r in clean} == {("Revenues", 100.0), ("NetIncomeLoss", 9.0)}


def test_negative_equity_and_zero_equity(spark):
    df = spark.createDataFrame(
        [(1, 10.0, -5.0, None), (2, 10.0, 0.0, 20.0), (3, 10.0, 40.0, None)],
        "cik long, net_income double, stockholders_equity double, total_equity double",
    )
    got = {r.cik: r for r in with_ratios(df).collect()}
    assert got[1].roe is None and got[1].roe_basis is None
    assert got[2].roe == 0.5
    assert got[3].roe == 0.25 and got[3].roe_basis == "ending"


def test_pe_switches_basis_when_far_apart(spark):
    df = spark.createDataFrame([(100.0, 10.0, 1.0, 50.0), (100.0, 10.0, 18.0, 50.0)], "price double, shares_outstanding double, eps_diluted double, net_income double")
    got = [r for r in with_valuation(df).collect()]
    assert (got[0].pe_ratio, got[0].pe_basis) == (20.0, "mcap_ni")
    assert got[1].pe_basis == "mcap_ni"
    near = with_valuation(df.withColumn("eps_diluted", F.lit(5.0))).first()
    assert (near.pe_ratio, near.pe_basis) == (20.0, "eps")


def test_numbers(spark):
    df = spark.createDataFrame([("x",), ("NaN",), ("Infinity",), ("1.5",), (None,)], "v string")
    assert [r[0] for r in df.select(safe_num("v")).collect()] == [None, None, None, 1.5, None]
    one = spark.range(1)
    assert one.select(safe_div(F.lit(1.0), F.lit(0.0))).first()[0] is None
    texts = [one.select(money_text(F.lit(v))).first()[0] for v in (1.234e12, -2.5e9, 3.0e6, 1234.4, None)]
    assert texts == ["$1.23T", "-$2.50B", "$3.00M", "$1,234", "N/A"]


@pytest.mark.parametrize("utc,want", [
    ("2026-06-14 15:00:00", "closed"), ("2026-06-15 12:00:00", "pre"), ("2026-06-15 13:30:00", "regular"),
    ("2026-06-15 20:00:00", "after"), ("2026-06-16 01:00:00", "closed"), ("2026-07-03 15:00:00", "closed"),
])
def test_market_clock(spark, utc, want):
    assert spark.range(1).select(market_session(F.lit(utc).cast("timestamp"))).first()[0] == want


def test_debt_and_spending_tags_of_single_filers(spark):
    rows = [
        (1, "LongTermNotesPayable", 122.3), (2, "LongTermDebtAndCapitalLeaseObligationsIncludingCurrentMaturities", 20.0),
        (3, "DebtAndCapitalLeaseObligations", 15.0), (4, "LongTermDebt", 5.0), (4, "DebtAndCapitalLeaseObligations", 9.0),
        (5, "NotesPayable", 25.0), (5, "LoansPayable", 1.7), (6, "NoncurrentPortionOfNoncurrentBorrowings", 3.0),
        (7, "PaymentsToAcquireRealEstate", 4.0), (8, "PaymentsForCapitalImprovements", 2.0), (8, "PaymentsToAcquireRealEstate", 4.0),
    ]
    facts = spark.createDataFrame([(c, "2020-12-31", t, v) for c, t, v in rows], "cik long, end_date string, concept string, value double")
    got = {(r["cik"], r["metric"]): r["value"] for r in rs.resolve_metrics(facts).collect()}
    assert [got[c, "long_term_debt"] for c in range(1, 7)] == [122.3, 20.0, 15.0, 5.0, 26.7, 3.0]
    assert got[7, "capital_expenditures"] == 4.0 and got[8, "capital_expenditures"] == 2.0
