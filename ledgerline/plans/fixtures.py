"""Fixture views over the driver tables, as one SQL text for both engines.

Every view is plain ANSI SQL that Spark and DuckDB read alike. Two spellings
differ and are produced per dialect: the row-generating unpivot and the
day-difference function, which is written ``DAYS(later, earlier)`` here.

Money is summed as exact decimals and turned into doubles last, so both
engines and every partitioning give the same bits.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _unpivot(dialect: str, names: tuple[str, ...], rows: list[tuple[str, ...]]) -> str:
    """A select-list item that turns one row into ``len(rows)`` rows."""
    if dialect == "spark":
        flat = ", ".join(item for row in rows for item in row)
        return f"stack({len(rows)}, {flat}) AS ({', '.join(names)})"
    cols = []
    for i, name in enumerate(names):
        cols.append(f"unnest([{', '.join(row[i] for row in rows)}]) AS {name}")
    return ", ".join(cols)


def _money(expr: str) -> str:
    return f"cast({expr} AS decimal(18,2))"


COMPANY = """
SELECT cast(s_suppkey + 1 AS bigint) AS cik,
       'T' || lpad(cast(s_suppkey AS string),
                   cast(greatest(4, length(cast(s_suppkey AS string))) AS int), '0')
           || CASE WHEN s_suppkey % 20 = 0 THEN '-A'
                   WHEN s_suppkey % 10 = 0 THEN '-B' ELSE '' END AS ticker,
       s_name AS name,
       cast(1000 + (s_suppkey * 73) % 8000 AS int) AS sic,
       n_name AS country,
       r_name AS sector,
       CASE s_suppkey % 3 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'Nasdaq' ELSE 'OTC' END AS exchange,
       cast(1000 + 10 * s_suppkey AS double) AS shares,
       CASE WHEN (s_suppkey + 1) % 10 = 9 THEN 'EUR' ELSE 'USD' END AS currency,
       (s_suppkey + 1) % 17 = 0 AS fund
FROM supplier
JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
"""

def _cents(c: str) -> str:
    """A source amount in whole cents: sums of integers are exact and cheap."""
    return f"cast(cast({c} AS decimal(12,2)) * 100 AS bigint)"


def _times(total: str, factor: str) -> str:
    return _money(f"cast({total} AS decimal(24,0)) * {factor}")


_NET = f"{_cents('l_extendedprice')} * (100 - {_cents('l_discount')})"

BASE = f"""
SELECT cast(l_suppkey + 1 AS bigint) AS cik,
       cast(year(l_shipdate) AS int) AS fy,
       cast(quarter(l_shipdate) AS int) AS q,
       {_times(f"sum({_NET})", "0.0001")} AS revenue,
       {_times(f"sum({_cents('l_extendedprice')})", "0.006")} AS cost,
       {_times(f"sum({_NET} * {_cents('l_tax')})", "0.000001")} AS tax,
       {_times(f"sum({_cents('l_quantity')})", "0.1")} AS da
FROM lineitem
WHERE l_shipdate IS NOT NULL
GROUP BY cast(l_suppkey + 1 AS bigint), cast(year(l_shipdate) AS int), cast(quarter(l_shipdate) AS int)
"""

# Standalone quarters with every flow the metrics need.
QUARTER = f"""
SELECT cik, fy, q, last_day(make_date(fy, q * 3, 1)) AS end_date,
       revenue, cost, tax, da,
       {_money("revenue - cost - tax")} AS net_income,
       {_money("revenue - cost")} AS pretax,
       {_money("revenue - cost - tax + revenue * 0.05")} AS ocf,
       {_money("revenue * 0.04")} AS capex,
       {_money("revenue * 0.01")} AS interest,
       {_money("revenue * 0.02")} AS opex
FROM fx_base
"""

_FLOWS = ("revenue", "cost", "tax", "da", "net_income", "pretax", "ocf", "capex", "interest", "opex")

# Year-to-date flows plus running balances.
YTD = (
    "SELECT cik, fy, q, end_date, "
    + ", ".join(f"{f} AS q_{f}" for f in ("revenue", "net_income"))
    + ", "
    + ", ".join(
        f"{_money(f'sum({f}) OVER (PARTITION BY cik, fy ORDER BY q)')} AS {f}" for f in _FLOWS
    )
    + ", "
    + _money("sum(revenue) OVER (PARTITION BY cik ORDER BY fy, q)")
    + " AS cum FROM fx_quarter"
)


def _facts(dialect: str) -> str:
    y = [
        ("'Revenues'", "CASE WHEN cik % 16 <> 0 THEN revenue END"),
        ("'CostOfRevenue'", "cost"),
        ("'IncomeTaxExpenseBenefit'", "tax"),
        ("'NetIncomeLoss'", "net_income"),
        ("'IncomeLossFromContinuingOperationsBeforeIncomeTaxes'", "pretax"),
        ("'NetCashProvidedByUsedInOperatingActivities'", "ocf"),
        ("'PaymentsToAcquirePropertyPlantAndEquipment'", "capex"),
        ("'InterestExpense'", "CASE WHEN cik % 4 <> 1 THEN interest END"),
        ("'OperatingExpenses'", "opex"),
        ("'OperatingIncomeLoss'", "CASE WHEN cik % 3 <> 0 THEN revenue - cost - opex END"),
        ("'DepreciationDepletionAndAmortization'", "CASE WHEN cik % 2 = 0 THEN da * 0.4 END"),
        ("'DepreciationAndAmortization'", "CASE WHEN cik % 2 = 0 THEN da END"),
        ("'Depreciation'", "CASE WHEN cik % 2 = 1 THEN da * 0.7 END"),
        ("'AmortizationOfIntangibleAssets'", "CASE WHEN cik % 2 = 1 THEN da * 0.3 END"),
        ("'PaymentsToAcquireEquipmentOnLease'", "CASE WHEN cik % 6 = 1 THEN capex * 0.5 END"),
        ("'InterestIncomeExpenseNet'", "CASE WHEN cik % 3 = 1 THEN revenue * 0.6 END"),
        ("'NoninterestIncome'", "CASE WHEN cik % 3 = 1 THEN revenue * 0.4 END"),
        ("'InvestmentBankingRevenue'", "CASE WHEN cik % 3 = 1 THEN revenue * 0.2 END"),
        ("'TradingGainsLosses'", "CASE WHEN cik % 3 = 1 THEN revenue * 0.1 END"),
        ("'EuropeSegmentRevenue'", "revenue * 0.3"),
        ("'UnitedStatesRevenue'", "revenue * 0.5"),
        ("'OnlineStoresRevenue'", "revenue * 0.25"),
        ("'SubscriptionRevenue'", "revenue * 0.35"),
    ]
    i = [
        ("'Assets'", "cum * 2"),
        ("'Liabilities'", "CASE WHEN cik % 19 <> 0 THEN cum * 1.2 END"),
        ("'StockholdersEquity'", "cum * 0.8"),
        ("'CashAndCashEquivalentsAtCarryingValue'", "cum * 0.2"),
        ("'AccountsReceivableNetCurrent'", "cum * 0.1"),
        ("'LiabilitiesCurrent'", "cum * 0.15"),
        ("'LongTermDebtNoncurrent'", "CASE WHEN cik % 4 <> 0 THEN cum * 0.3 END"),
        ("'NotesPayable'", "CASE WHEN cik % 4 = 0 THEN cum * 0.1 END"),
        ("'SecuredDebt'", "CASE WHEN cik % 4 = 0 THEN cum * 0.05 END"),
        ("'DebtCurrent'", "CASE WHEN cik % 3 = 0 THEN cum * 0.05 END"),
    ]
    rows = [("'Y'", c, _money(e)) for c, e in y]
    rows += [("'I'", c, _money(e)) for c, e in i]
    rows += [
        ("'S'", "'Revenues'", _money("CASE WHEN q IN (2, 3) AND cik % 16 <> 0 THEN q_revenue END")),
        ("'S'", "'NetIncomeLoss'", _money("CASE WHEN q IN (2, 3) THEN q_net_income END")),
        ("'R'", "'Revenues'", _money("CASE WHEN cik % 16 = 0 THEN NULL WHEN q = 4 AND cik % 7 = 0 THEN revenue * 1.01 WHEN q = 4 THEN revenue END")),
        ("'R'", "'NetIncomeLoss'", _money("CASE WHEN q = 4 THEN net_income END")),
        ("'D'", "'Revenues'", _money("revenue * 0.5")),
        ("'Y'", "'RevenueByProductAxis'", _money("revenue * 0.5")),
        ("'Y'", "'RevenueRecognitionTextBlock'", _money("1")),
        ("'Y'", "'DeferredRevenues'", _money("revenue * 0.1")),
        ("'Y'", "'acme_TotalRevenue'", _money("CASE WHEN cik % 9 = 0 OR cik % 16 = 0 THEN revenue * 0.9 END")),
        ("'Y'", "'beta_TotalRevenue'", _money("CASE WHEN cik % 32 = 0 THEN revenue * 0.95 END")),
        ("'Y'", "'acme_ForecastTotalRevenue'", _money("CASE WHEN cik % 16 = 0 THEN revenue * 3 END")),
        ("'Y'", "'acme_GoodwillImpairment'", _money("1")),
        ("'I'", "'acme_Goodwill'", _money("CASE WHEN cik % 10 = 3 THEN cum * 0.01 END")),
        ("'U'", "'Revenues'", _money("CASE WHEN cik % 10 = 9 THEN revenue * 1.1 END")),
        ("'C'", "'EntityCommonStockSharesOutstanding'", _money("1000 + 10 * (cik - 1)")),
    ]
    return f"""
SELECT cik,
       CASE WHEN concept = 'Revenues' AND kind <> 'U' AND cik % 5 = 0
            THEN 'RevenueFromContractWithCustomerExcludingAssessedTax'
            ELSE concept END AS concept,
       concept AS label,
       cast(value AS double) AS value,
       CASE WHEN kind IN ('I', 'C') THEN cast(NULL AS date)
            WHEN kind = 'S' THEN make_date(fy, q * 3 - 2, 1)
            ELSE make_date(fy, 1, 1) END AS start_date,
       CASE WHEN kind = 'C' THEN end_date + 20 ELSE end_date END AS end_date,
       CASE WHEN kind = 'R' THEN last_day(make_date(fy + 1, 12, 1)) + 60
            WHEN q = 4 THEN end_date + 60 ELSE end_date + 40 END AS filed,
       CASE WHEN q = 4 THEN '10-K' ELSE '10-Q' END AS form,
       lpad(cast(cik AS string), 10, '0') || '-'
         || lpad(cast((CASE WHEN kind = 'R' THEN fy + 2 WHEN q = 4 THEN fy + 1 ELSE fy END) % 100 AS string), 2, '0')
         || '-' || lpad(cast(q AS string), 6, '0') AS accn,
       cast(CASE WHEN kind = 'R' THEN fy + 1 ELSE fy END AS int) AS fy,
       CASE WHEN q = 4 THEN 'FY' ELSE 'Q' || cast(q AS string) END AS fp,
       CASE WHEN kind = 'C' THEN 'shares'
            WHEN kind <> 'U' AND cik % 10 = 9 THEN 'EUR' ELSE 'USD' END AS units,
       CASE WHEN kind = 'C' THEN 'dei' ELSE 'us-gaap' END AS taxonomy,
       CASE WHEN kind = 'D' THEN 'ProductOrServiceAxis=Hardware' END AS dimension
FROM (
  SELECT cik, fy, q, end_date,
         {_unpivot(dialect, ("kind", "concept", "value"), rows)}
  FROM fx_ytd
  WHERE NOT (cik % 11 = 0 AND fy = 1998 AND q = 2)
    AND NOT (cik % 13 = 0 AND q IN (1, 3))
) t
WHERE value IS NOT NULL
"""


WIDE_METRICS = (
    "revenue cost_of_revenue gross_profit operating_income net_income income_tax_expense "
    "income_before_tax interest_expense operating_expenses depreciation_amortization "
    "operating_cash_flow capital_expenditures free_cash_flow ebitda total_assets total_liabilities "
    "stockholders_equity total_equity minority_interest current_assets current_liabilities "
    "cash_and_equivalents long_term_debt short_term_debt shares_outstanding eps_diluted"
).split()


def _dbl(expr: str, scale: int = 2) -> str:
    return f"cast(cast({expr} AS decimal(22,{scale})) AS double)"


# One row per company and year. The CASE terms plant the gaps and contradictions
# that the ratio, repair and validation rules must handle.
WIDE = f"""
SELECT cik, fy, end_date,
       {_dbl("revenue")} AS revenue,
       {_dbl("cost")} AS cost_of_revenue,
       {_dbl("CASE WHEN cik % 3 <> 0 THEN revenue - cost END")} AS gross_profit,
       {_dbl("CASE WHEN cik % 4 <> 2 THEN revenue - cost - opex END")} AS operating_income,
       {_dbl("CASE WHEN cik % 31 = 0 THEN revenue * 1.5 ELSE net_income END")} AS net_income,
       {_dbl("CASE WHEN cik % 9 = 4 THEN -tax ELSE tax END")} AS income_tax_expense,
       {_dbl("pretax")} AS income_before_tax,
       {_dbl("CASE WHEN cik % 4 <> 1 THEN interest END")} AS interest_expense,
       {_dbl("opex")} AS operating_expenses,
       {_dbl("da")} AS depreciation_amortization,
       {_dbl("ocf")} AS operating_cash_flow,
       {_dbl("CASE WHEN cik % 6 <> 5 THEN capex END")} AS capital_expenditures,
       {_dbl("CASE WHEN cik % 6 <> 5 THEN ocf - capex END")} AS free_cash_flow,
       {_dbl("CASE WHEN cik % 7 <> 6 THEN pretax + da END")} AS ebitda,
       {_dbl("cum * 2")} AS total_assets,
       {_dbl("CASE WHEN cik % 19 = 0 THEN NULL WHEN cik % 8 = 3 THEN cum * 2 WHEN cik % 8 = 5 THEN cum * 0.9 ELSE cum * 1.2 END")} AS total_liabilities,
       {_dbl("CASE WHEN cik % 23 = 0 THEN -cum WHEN cik % 29 = 0 THEN 0 ELSE cum * 0.8 END")} AS stockholders_equity,
       {_dbl("CASE WHEN cik % 29 = 0 THEN cum * 0.7 END")} AS total_equity,
       {_dbl("CASE WHEN cik % 8 = 6 THEN cum * 0.3 END")} AS minority_interest,
       {_dbl("cum * 0.5")} AS current_assets,
       {_dbl("CASE WHEN cik % 12 <> 0 THEN cum * 0.15 ELSE 0 END")} AS current_liabilities,
       {_dbl("CASE WHEN cik % 5 <> 3 THEN cum * 0.2 END")} AS cash_and_equivalents,
       {_dbl("CASE WHEN cik % 4 <> 0 THEN cum * 0.3 END")} AS long_term_debt,
       {_dbl("CASE WHEN cik % 3 = 0 THEN cum * 0.05 END")} AS short_term_debt,
       cast(1000 + 10 * (cik - 1) AS double) AS shares_outstanding,
       CASE WHEN cik % 5 <> 2 THEN cast(net_income AS double) / cast(1000 + 10 * (cik - 1) AS double) END AS eps_diluted
FROM fx_ytd WHERE q = 4
"""


def _long(dialect: str) -> str:
    rows = [(f"'{m}'", m) for m in WIDE_METRICS]
    return f"""
SELECT cik, fy, end_date, metric, value
FROM (SELECT cik, fy, end_date, {_unpivot(dialect, ("metric", "value"), rows)} FROM fx_wide) t
WHERE value IS NOT NULL
"""


QUARTERS = f"""
SELECT cik, fy, q, end_date, 'Q' || cast(q AS string) AS fiscal_period,
       CASE WHEN q = 4 THEN '10-K' ELSE '10-Q' END AS form,
       CASE WHEN cik % 11 = 0 AND fy = 1998 AND q = 2 THEN 'ytd_fallback'
            WHEN q = 1 THEN 'standalone'
            WHEN q = 4 THEN 'q4_synthesized'
            WHEN cik % 3 = 0 THEN 'standalone'
            ELSE 'standalone_decumulated' END AS quality,
       {_dbl("revenue")} AS revenue,
       {_dbl("revenue - cost")} AS gross_profit,
       {_dbl("revenue - cost - opex")} AS operating_income,
       {_dbl("net_income")} AS net_income,
       {_dbl("pretax + da")} AS ebitda,
       {_dbl("ocf")} AS operating_cash_flow,
       {_dbl("-capex")} AS capital_expenditures,
       {_dbl("ocf - capex")} AS free_cash_flow,
       {_dbl("tax")} AS income_tax_expense,
       {_dbl("pretax")} AS income_before_tax,
       {_dbl("CASE WHEN cik % 4 <> 1 OR q <> 2 THEN interest END")} AS interest_expense,
       {_dbl("cum * 2")} AS total_assets,
       {_dbl("cum * 1.2")} AS total_liabilities,
       {_dbl("cum * 0.8")} AS stockholders_equity,
       {_dbl("cum * 0.2")} AS cash_and_equivalents,
       {_dbl("CASE WHEN cik % 4 <> 0 THEN cum * 0.3 END")} AS total_debt,
       CASE WHEN cik % 14 <> 0 THEN cast(1000 + 10 * (cik - 1) AS double) END AS shares_outstanding,
       CASE WHEN cik % 5 <> 2 THEN {_dbl("net_income / 1000", 2)} END AS eps_diluted
FROM (SELECT f.*, y.cum FROM fx_quarter f JOIN fx_ytd y ON f.cik = y.cik AND f.fy = y.fy AND f.q = y.q) t
WHERE NOT (cik % 13 = 0 AND q IN (1, 3))
"""

FILINGS = """
SELECT cik, accn, form, min(filed) AS filed, max(end_date) AS report_date,
       CASE WHEN cik % 2 = 0 THEN 'Annual or quarterly report' ELSE 'nan' END AS description
FROM fx_facts WHERE taxonomy <> 'dei' AND end_date <= filed
GROUP BY cik, accn, form
UNION ALL
SELECT cast(o_custkey % (SELECT count(*) FROM supplier) + 1 AS bigint) AS cik,
       lpad(cast(o_orderkey AS string), 10, '9') || '-00-' || lpad(cast(o_orderkey % 1000000 AS string), 6, '0') AS accn,
       CASE o_orderpriority WHEN '1-URGENT' THEN '8-K' WHEN '2-HIGH' THEN '8-K/A'
            WHEN '3-MEDIUM' THEN 'DEF 14A' WHEN '4-NOT SPECIFIED' THEN '10-K/A' ELSE 'SC 13G' END AS form,
       cast(o_orderdate AS date) AS filed,
       cast(NULL AS date) AS report_date,
       CASE WHEN o_orderkey % 3 = 0 THEN 'None' ELSE 'Item 2.02, Item 9.01' END AS description
FROM orders
"""

VENDOR = f"""
SELECT cik, fy, 'annual' AS timeframe, metric,
       end_date + cast(cik % 20 AS int) AS end_date,
       value * (1 + cast(cik % 9 AS double) / 100) AS value
FROM fx_long WHERE metric IN ('revenue', 'net_income', 'total_assets', 'stockholders_equity')
"""

RATES = """
SELECT 'EUR' AS from_ccy, 'USD' AS to_ccy, cast(1.1 AS double) AS rate
UNION ALL SELECT 'USD', 'JPY', cast(150 AS double)
"""


# The lines behind the breakdowns, as Spark deals them out before they are unrolled.
LINES = f"""
    SELECT cast(l_suppkey + 1 AS bigint) AS cik, cast(year(l_shipdate) AS int) AS fy,
           p_type, p_brand, r_name,
           {_NET} AS amount
    FROM lineitem
    JOIN part ON l_partkey = p_partkey
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
"""


def _dims(dialect: str) -> str:
    lines = "SELECT * FROM fx_lines" if dialect == "spark" else LINES.strip()
    rows = [
        ("'ProductOrServiceAxis'", "p_type"),
        ("'StatementBusinessSegmentsAxis'", "p_brand"),
        ("'StatementGeographicalAxis'", "r_name"),
    ]
    return f"""
SELECT cik, fy, axis, label, cast({_times('sum(amount)', '0.0001')} AS double) AS value
FROM (
  SELECT cik, fy, {_unpivot(dialect, ("axis", "label"), rows)}, amount
  FROM (
    {lines}
  ) j
) u
GROUP BY cik, fy, axis, label
"""


# Breakdown rows as a filer tags them: members, their total, a subtotal of two
# members, and the generic product/service pair that repeats the total.
SEGMENTS = """
SELECT cik, fy, axis, label, value FROM fx_dims
UNION ALL
SELECT cik, fy, axis, 'Total ' || axis, cast(sum(cast(value AS decimal(18,2))) AS double)
FROM fx_dims GROUP BY cik, fy, axis
UNION ALL
SELECT cik, fy, axis, 'Heavy Goods', cast(sum(cast(value AS decimal(18,2))) AS double)
FROM fx_dims WHERE axis = 'ProductOrServiceAxis' AND label IN ('ECONOMY', 'STANDARD')
GROUP BY cik, fy, axis
UNION ALL
SELECT cik, fy, axis, 'Product', cast(cast(sum(cast(value AS decimal(18,2))) * 0.7 AS decimal(18,2)) AS double)
FROM fx_dims WHERE axis = 'ProductOrServiceAxis' GROUP BY cik, fy, axis
UNION ALL
SELECT cik, fy, axis, 'Service', cast(cast(sum(cast(value AS decimal(18,2))) * 0.3 AS decimal(18,2)) AS double)
FROM fx_dims WHERE axis = 'ProductOrServiceAxis' GROUP BY cik, fy, axis
"""

HOLDINGS = """
SELECT cast(l_suppkey + 1 AS bigint) AS cik, p_name AS institution,
       cast(sum(cast(l_quantity AS decimal(12,2))) AS double) AS shares,
       cast(sum(cast(l_extendedprice AS decimal(12,2))) AS double) AS value,
       cast(cast(sum(cast(l_quantity AS decimal(12,2))) / 100 AS decimal(12,2)) AS double) AS pct,
       max(cast(l_shipdate AS date)) AS filed,
       max(l_orderkey) AS filing_no
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY cast(l_suppkey + 1 AS bigint), p_name
"""

INSIDER = """
SELECT cast(user_id % 10 + 1 AS bigint) AS cik, cast(user_id AS string) AS insider,
       cast(ts AS date) AS txn_date, ts,
       CASE event_type WHEN 'purchase' THEN 'P' WHEN 'signup' THEN 'S' WHEN 'click' THEN 'M'
            WHEN 'view' THEN 'A' WHEN 'error' THEN 'G' ELSE 'Z' END AS code,
       cast(cast(value * 10 AS decimal(12,0)) AS double) AS shares,
       cast(cast(value AS decimal(12,2)) AS double) AS price,
       event_id AS accn
FROM events
"""

BARS = """
SELECT event_type || '-' || cast(user_id % 20 AS string) AS symbol,
       cast(user_id % 20 + 1 AS bigint) AS cik,
       cast(ts AS date) AS day,
       min_by(value, ts) AS open, max(value) AS high, min(value) AS low,
       max_by(value, ts) AS close, count(*) AS volume
FROM events WHERE value IS NOT NULL
GROUP BY event_type || '-' || cast(user_id % 20 AS string), cast(user_id % 20 + 1 AS bigint), cast(ts AS date)
"""

PRICES = """
SELECT c.cik, cast(50 + c.cik % 200 AS double) AS price
FROM fx_company c WHERE c.cik % 7 <> 0
"""

EDGES = """
SELECT 'income' AS statement, 'N' || cast(n_nationkey AS string) AS child,
       'R' || cast(n_regionkey AS string) AS parent, cast(1 AS double) AS weight,
       cast(n_nationkey AS int) AS ord
FROM nation
UNION ALL
SELECT 'income', 'S' || cast(s_suppkey AS string), 'N' || cast(s_nationkey AS string),
       cast(CASE WHEN s_suppkey % 4 = 0 THEN -1 ELSE 1 END AS double), cast(s_suppkey AS int)
FROM supplier
UNION ALL
SELECT 'balance', 'S' || cast(s_suppkey AS string), 'S' || cast(s_suppkey + (CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END) AS string),
       cast(1 AS double), cast(s_suppkey AS int)
FROM supplier
"""

# Statement trees per annual filing: not every filing has a calculation tree, tags differ by company,
# some put an own revenue node above the usual one, and one in 13 hangs two nodes on each other.
TREES = """
SELECT accn, tree, 'income' AS statement, child, parent, cast(ord AS int) AS ord
FROM (
  SELECT f.accn, f.cik, t.tree, n.child, n.parent, n.ord, n.every, n.rest
  FROM (SELECT DISTINCT accn, cik FROM fx_filings WHERE form = '10-K') f
  CROSS JOIN (SELECT 'calc' AS tree UNION ALL SELECT 'pres') t
  CROSS JOIN (
    SELECT 'NetIncomeLoss' AS child, cast(NULL AS string) AS parent, 0 AS ord, 1 AS every, 0 AS rest
    UNION ALL SELECT 'OperatingIncomeLoss', 'NetIncomeLoss', 1, 1, 0
    UNION ALL SELECT 'acme_TotalRevenue', 'OperatingIncomeLoss', 2, 9, 0
    UNION ALL SELECT 'beta_TotalRevenue', 'acme_TotalRevenue', 3, 2, 0
    UNION ALL SELECT 'Revenues', 'OperatingIncomeLoss', 4, 2, 0
    UNION ALL SELECT 'RevenueFromContractWithCustomerExcludingAssessedTax', 'OperatingIncomeLoss', 5, 5, 0
    UNION ALL SELECT 'SubscriptionRevenue', 'Revenues', 6, 1, 0
    UNION ALL SELECT 'OnlineStoresRevenue', 'SubscriptionRevenue', 7, 1, 0
    UNION ALL SELECT 'DeferredRevenues', 'NetIncomeLoss', 8, 1, 0
    UNION ALL SELECT 'CostOfRevenue', 'OperatingIncomeLoss', 9, 1, 0
    UNION ALL SELECT 'UnitedStatesRevenue', 'EuropeSegmentRevenue', 10, 13, 1
    UNION ALL SELECT 'EuropeSegmentRevenue', 'UnitedStatesRevenue', 11, 13, 1
  ) n
) x
WHERE cik % every = rest AND NOT (tree = 'calc' AND cik % 3 = 0) AND NOT (tree = 'pres' AND cik % 7 = 2 AND ord < 6)
"""

CHUNKS = """
SELECT d.doc_id, d.source, cast(d.n_chars AS double) AS weight,
       cast(l.quality AS double) AS quality, cast(l.toxic AS double) AS toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

OBSERVATIONS = """
SELECT cik, metric, 'FY' AS period_type, end_date,
       CASE WHEN batch > 0 THEN value * (1 + cast(batch AS double) / 8) ELSE value END AS value, batch
FROM (
  SELECT cik, metric, end_date, value, cast(cik % 4 AS int) AS batch FROM fx_long
  UNION ALL
  SELECT cik, metric, end_date, value, cast(cik % 4 + 1 AS int) AS batch FROM fx_long WHERE cik % 3 = 0
) t
"""

_DEPS = {
    "fx_company": (), "fx_base": (), "fx_quarter": ("fx_base",), "fx_ytd": ("fx_quarter",),
    "fx_facts": ("fx_ytd",), "fx_wide": ("fx_ytd",), "fx_long": ("fx_wide",),
    "fx_quarters": ("fx_ytd",), "fx_filings": ("fx_facts",), "fx_vendor": ("fx_long",),
    "fx_rates": (), "fx_dims": (), "fx_segments": ("fx_dims",), "fx_holdings": (),
    "fx_insider": (), "fx_bars": (), "fx_prices": ("fx_company",), "fx_edges": (), "fx_trees": ("fx_filings",),
    "fx_chunks": (), "fx_obs": ("fx_long",),
}


def view_sql(name: str, dialect: str) -> str:
    """The text of one fixture view for ``spark`` or ``duckdb``."""
    text = {
        "fx_company": COMPANY, "fx_base": BASE, "fx_quarter": QUARTER, "fx_ytd": YTD,
        "fx_wide": WIDE, "fx_quarters": QUARTERS, "fx_filings": FILINGS, "fx_vendor": VENDOR,
        "fx_rates": RATES, "fx_segments": SEGMENTS, "fx_holdings": HOLDINGS,
        "fx_insider": INSIDER, "fx_bars": BARS, "fx_prices": PRICES, "fx_edges": EDGES, "fx_trees": TREES,
        "fx_chunks": CHUNKS, "fx_obs": OBSERVATIONS,
    }.get(name)
    if text is None:
        text = {"fx_facts": _facts, "fx_long": _long, "fx_dims": _dims}[name](dialect)
    return days(text, dialect)


def days(text: str, dialect: str) -> str:
    """Spell ``DAYS(later, earlier)`` for the dialect."""
    if dialect == "spark":
        return text.replace("DAYS(", "datediff(")
    return re.sub(r"DAYS\(([^,()]+),\s*([^,()]+)\)", r"date_diff('day', \2, \1)", text)


def closure(names: list[str]) -> list[str]:
    """The views needed for ``names``, dependencies first."""
    out: list[str] = []

    def visit(n: str) -> None:
        for d in _DEPS[n]:
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def oracle(body: str) -> str:
    """Prefix ``body`` with the fixture views it mentions, in DuckDB spelling."""
    used = [n for n in _DEPS if re.search(rf"\b{n}\b", body)]
    ctes = ",\n".join(f"{n} AS ({view_sql(n, 'duckdb').strip()})" for n in closure(used))
    body = days(body.strip(), "duckdb")
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"


# Tables whose rows are costly to process.
_HEAVY_ROWS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.

    Text in fewer row groups than there are cores is spread out. Inputs of any
    size have more, so this adds no shuffle to them.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _HEAVY_ROWS and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame; nothing but row counts is computed until it is used."""
    texts = {n: view_sql(n, "spark") for n in closure([name])}
    if "fx_dims" in texts:
        texts = {"fx_lines": LINES, **texts}
    for t in BASE_TABLES:
        if any(re.search(rf"\b{t}\b", s) for s in texts.values()):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    for n, text in texts.items():
        view = spark.sql(text)
        if n in _UNROLLED:
            view = view.repartition(_parts(spark, n), "cik")
        view.createOrReplaceTempView(n)
    return spark.table(name)


# Views whose rows those above them unroll to many, company by company.
_UNROLLED = ("fx_ytd", "fx_lines")
_LINES_A_TASK = 200_000
_QUARTERS_A_TASK = 10_000


def _parts(spark: SparkSession, view: str) -> int:
    """Tasks for views that are unrolled: they grow with the rows, of which only the number is read.

    Spark would merge partitions by their size before the rows are unrolled. A
    company's quarter is one year-to-date row however few lines it has, so these
    rows are estimated too, unless one a line would need no more tasks.
    """
    lines = spark.table("lineitem")
    n = lines.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // _LINES_A_TASK))
    if view == "fx_ytd" and n > tasks * _QUARTERS_A_TASK:
        quarter = F.xxhash64("l_suppkey", F.year("l_shipdate"), F.quarter("l_shipdate"))
        tasks = max(tasks, -(-lines.agg(F.approx_count_distinct(quarter)).first()[0] // _QUARTERS_A_TASK))
    return tasks
