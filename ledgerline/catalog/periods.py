"""Quarters, fourth quarters, trailing twelve months and period comparisons."""

from pyspark.sql import functions as F

from ledgerline.catalog.registry import query
from ledgerline.functions import dates as d
from ledgerline.operators import periods as pr

YTD_METRICS = {
    "revenue": "revenue", "net_income": "net_income", "cost_of_revenue": "cost", "operating_cash_flow": "ocf",
    "capital_expenditures": "capex", "income_tax_expense": "tax", "interest_expense": "interest",
    "depreciation_amortization": "da",
}
GAPS = "NOT (cik % 11 = 0 AND fy = 1998 AND q = 2) AND NOT (cik % 13 = 0 AND q IN (1, 3))"
INTEREST = "CASE WHEN cik % 4 <> 1 OR q <> 1 THEN interest END"
SHARES = "CASE WHEN cik % 6 <> 0 THEN 1000.0 + cik END"


def _ytd(i, quarters=True):
    cols = [F.col(src).cast("double").alias(m) for m, src in YTD_METRICS.items() if m != "interest_expense"]
    df = i.fx_ytd.select(
        "cik", "fy", F.col("q").alias("rank"), F.col("q").isin(2, 3).alias("is_ytd"), "end_date", *cols,
        F.expr(f"cast({INTEREST} AS double)").alias("interest_expense"),
        F.expr("cast(cum * 2 AS double)").alias("total_assets"),
        F.expr(f"cast({SHARES} AS double)").alias("shares_outstanding"),
        F.expr("cast(cast(net_income / 1000 AS decimal(18,2)) AS double)").alias("eps_diluted"),
        F.expr("cast(ocf - capex AS double)").alias("free_cash_flow"),
        F.expr("cast(revenue AS double)").alias("ebitda"), "q",
    ).where(GAPS)
    return (df.where("q <= 3") if quarters else df.where("q = 4")).drop("q")


BASE = f"""ytd AS (SELECT cik, fy, q, end_date, revenue::double AS revenue, net_income::double AS net_income, cost::double AS cost, ocf::double AS ocf,
   capex::double AS capex, tax::double AS tax, ({INTEREST})::double AS interest, da::double AS da, (cum * 2)::double AS total_assets,
   ({SHARES})::double AS shares, cast(net_income / 1000 AS decimal(18,2))::double AS eps, (ocf - capex)::double AS fcf, revenue::double AS ebitda
  FROM fx_ytd WHERE {GAPS}),
lagged AS (SELECT a.*, p.cik AS pcik, {', '.join(f'p.{m} AS p_{m}' for m in 'revenue net_income cost ocf capex tax interest da eps'.split())}
  FROM ytd a LEFT JOIN ytd p ON a.cik = p.cik AND a.fy = p.fy AND a.q = p.q + 1 WHERE a.q <= 3)"""


def _d(m):
    return f"round(cast({m} AS decimal(28,4)) - cast(p_{m} AS decimal(28,4)), 4)::double"


def _case(new, old):
    return f"CASE WHEN quality = 'standalone_decumulated' THEN {new} ELSE {old} END"


DECUMULATED = f"""{BASE},
labelled AS (SELECT *, CASE WHEN q = 1 THEN 'standalone' WHEN pcik IS NULL THEN 'ytd_fallback' ELSE 'standalone_decumulated' END AS quality FROM lagged),
flows AS (SELECT cik, fy, q, end_date, quality, q > 1 AND pcik IS NULL AS is_ytd, total_assets, shares, eps, p_eps, fcf, ebitda,
  {', '.join(f'{_case(_d(m), m)} AS {m}' for m in 'revenue net_income cost ocf capex tax interest da'.split())} FROM labelled),
standalone AS (SELECT cik, fy, q AS rank, is_ytd, end_date, quality, revenue, net_income, cost AS cost_of_revenue, ocf AS operating_cash_flow,
  capex AS capital_expenditures, tax AS income_tax_expense, da AS depreciation_amortization, interest AS interest_expense, total_assets, shares AS shares_outstanding,
  {_case('round(cast(ocf AS decimal(28,4)) - abs(cast(capex AS decimal(28,4))), 4)::double', 'fcf')} AS free_cash_flow,
  {_case('''coalesce(cast(net_income / shares AS decimal(28,2))::double, CASE WHEN net_income <> 0 AND eps - p_eps <> 0 AND (cast(eps - p_eps AS decimal(28,2)) < 0) <> (net_income < 0) THEN NULL
     ELSE cast(eps - p_eps AS decimal(28,2))::double END)''', 'eps')} AS eps_diluted,
  {_case('(cast(net_income AS decimal(28,4)) + abs(coalesce(cast(interest AS decimal(28,4)), 0)) + coalesce(cast(tax AS decimal(28,4)), 0) + abs(cast(da AS decimal(28,4))))::double', 'ebitda')} AS ebitda
  FROM flows)"""


@query("decumulate_quarters", f"WITH {DECUMULATED} SELECT * FROM standalone")
def decumulate_quarters(i):
    return pr.decumulate(_ytd(i))


@query("match_annual_to_q3", """
WITH q3 AS (SELECT cik, fy, end_date AS q3_end FROM fx_quarters WHERE q = 3),
k AS (SELECT DISTINCT cik, accn, report_date, form FROM fx_filings WHERE form = '10-K'),
m AS (SELECT q3.*, k.accn, k.report_date, row_number() OVER (PARTITION BY q3.cik, q3.fy ORDER BY k.report_date DESC, k.accn) AS rn
  FROM q3 JOIN k ON q3.cik = k.cik AND DAYS(report_date, q3_end) BETWEEN 60 AND 130)
SELECT cik, fy, q3_end, accn, report_date FROM m WHERE rn = 1
""")
def match_annual_to_q3(i):
    q3 = i.fx_quarters.where("q = 3").select("cik", "fy", F.col("end_date").alias("q3_end"))
    annual = i.fx_filings.where("form = '10-K'").select("cik", "accn", "report_date").distinct()
    return pr.match_annual_to_q3(q3, annual)


FLOW3 = "revenue net_income cost_of_revenue operating_cash_flow capital_expenditures income_tax_expense interest_expense depreciation_amortization".split()
YEAR_COL = {"cost_of_revenue": "cost", "operating_cash_flow": "ocf", "capital_expenditures": "capex", "income_tax_expense": "tax",
            "interest_expense": "interest", "depreciation_amortization": "da"}


@query("synthesize_fourth_quarter", f"""
WITH {DECUMULATED},
g AS (SELECT cik AS gcik, fy AS gfy, {', '.join(f'CASE WHEN count({m}) = 3 THEN sum(cast({m} AS decimal(28,4))) END AS s_{m}' for m in FLOW3)},
  CASE WHEN count(eps_diluted) = 3 THEN sum(cast(eps_diluted AS decimal(28,4)))::double END AS s_eps
  FROM standalone WHERE quality LIKE 'standalone%' GROUP BY cik, fy HAVING count(*) = 3),
f AS (SELECT y.*, g.*, {', '.join(f'(cast(y.{YEAR_COL.get(m, m)} AS decimal(28,4)) - s_{m})::double AS n_{m}' for m in FLOW3)} FROM ytd y JOIN g ON cik = gcik AND fy = gfy WHERE q = 4)
SELECT cik, fy, 4 AS rank, false AS is_ytd, end_date, 'q4_synthesized' AS quality, {', '.join(f'n_{m} AS {m}' for m in FLOW3)}, total_assets, shares AS shares_outstanding,
  (cast(n_operating_cash_flow AS decimal(28,4)) - abs(cast(n_capital_expenditures AS decimal(28,4))))::double AS free_cash_flow,
  coalesce(cast(n_net_income / shares AS decimal(28,2))::double, CASE WHEN n_net_income <> 0 AND cast(eps - s_eps AS decimal(28,2)) <> 0 AND (eps - s_eps < 0) <> (n_net_income < 0) THEN NULL
     ELSE cast(eps - s_eps AS decimal(28,2))::double END) AS eps_diluted,
  (cast(n_net_income AS decimal(28,4)) + abs(coalesce(cast(n_interest_expense AS decimal(28,4)), 0)) + coalesce(cast(n_income_tax_expense AS decimal(28,4)), 0)
    + abs(cast(n_depreciation_amortization AS decimal(28,4))))::double AS ebitda
FROM f WHERE n_revenue > 0
""")
def synthesize_fourth_quarter(i):
    annual = _ytd(i, quarters=False).withColumnRenamed("end_date", "report_date").drop("rank", "is_ytd")
    return pr.synthesize_q4(pr.decumulate(_ytd(i)), annual)


@query("first_three_quarters_present", """
SELECT cik, fy, bool_or(q = 1) AND bool_or(q = 2) AND bool_or(q = 3) AS complete FROM fx_quarters GROUP BY cik, fy
""")
def first_three_quarters_present(i):
    ranks = i.fx_quarters.groupBy("cik", "fy").agg(F.collect_set("q").alias("ranks"))
    return ranks.select("cik", "fy", pr.has_first_three(F.col("ranks")).alias("complete"))


@query("summable_quarters", """
SELECT quality, count(*) AS n, sum(CASE WHEN quality IN ('standalone', 'standalone_decumulated', 'q4_synthesized') THEN 1 ELSE 0 END)::bigint AS usable
FROM fx_quarters GROUP BY quality
""")
def summable_quarters(i):
    return i.fx_quarters.groupBy("quality").agg(F.count("*").alias("n"), F.count_if(pr.summable()).alias("usable"))


OKQ = "quality IN ('standalone', 'standalone_decumulated', 'q4_synthesized')"
NEWEST5 = f"top AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY end_date DESC) AS n FROM fx_quarters WHERE {OKQ})"


def _n(k, c):
    return f"max(CASE WHEN n = {k} THEN {c} END)"


TTM_SQL = f"""
WITH {NEWEST5},
a AS (SELECT cik, least(count(*), 5) AS n_quarters, {_n(1, 'end_date')} AS as_of, {_n(1, 'fy')} AS fiscal_year, {_n(1, 'form')} AS form, DAYS({{e1}}, {{e4}}) AS span_days,
  {', '.join(f"CASE WHEN count(CASE WHEN n <= 4 THEN {m} END) = 4 THEN sum(CASE WHEN n <= 4 THEN cast({m} AS decimal(28,4)) END)::double END AS {m}" for m in pr.TTM_FLOWS)},
  {', '.join(f"{_n(1, m)} AS {m}" for m in pr.TTM_BALANCES)}, bool_and(CASE WHEN n <= 4 THEN quality = 'standalone' END) AS plain,
  CASE WHEN count(CASE WHEN n <= 4 THEN eps_diluted END) = 4 THEN sum(CASE WHEN n <= 4 THEN cast(eps_diluted AS decimal(28,4)) END)::double END AS eps_sum,
  DAYS({{e1}}, {{e5}}) AS gap, {_n(5, 'stockholders_equity')} AS eq5, {_n(5, 'total_assets')} AS as5
  FROM top GROUP BY cik),
b AS (SELECT *, CASE WHEN n_quarters < 4 THEN 'too_few_quarters' WHEN span_days BETWEEN 240 AND 300 THEN 'ok' ELSE 'window_check_failed' END AS status FROM a)
SELECT cik, status, n_quarters, span_days, {', '.join(f"CASE WHEN status = 'ok' THEN {c} END AS {n}" for n, c in
   [('as_of', 'as_of'), ('fiscal_year', 'fiscal_year'), ('form', 'form'), ('quality', "'ttm_sum_4q'")] +
   [(m, 'abs(capital_expenditures)' if m == 'capital_expenditures' else m) for m in pr.TTM_FLOWS + pr.TTM_BALANCES] +
   [('eps_diluted', 'coalesce(net_income / shares_outstanding, CASE WHEN plain THEN eps_sum END)'), ('total_equity', 'stockholders_equity'),
    ('net_debt', 'total_debt - coalesce(cash_and_equivalents, 0)'),
    ('prior_equity', 'CASE WHEN gap BETWEEN 330 AND 400 THEN eq5 END'), ('prior_assets', 'CASE WHEN gap BETWEEN 330 AND 400 THEN as5 END')])}
FROM b"""
for _k in (1, 4, 5):
    TTM_SQL = TTM_SQL.replace("{e%d}" % _k, f"max(CASE WHEN n = {_k} THEN end_date END)")
TTM_SQL = TTM_SQL.replace("DAYS(max(CASE WHEN n = 1 THEN end_date END), max(CASE WHEN n = 4 THEN end_date END))",
                          "date_diff('day', max(CASE WHEN n = 4 THEN end_date END), max(CASE WHEN n = 1 THEN end_date END))")
TTM_SQL = TTM_SQL.replace("DAYS(max(CASE WHEN n = 1 THEN end_date END), max(CASE WHEN n = 5 THEN end_date END))",
                          "date_diff('day', max(CASE WHEN n = 5 THEN end_date END), max(CASE WHEN n = 1 THEN end_date END))")


@query("trailing_twelve_months", TTM_SQL)
def trailing_twelve_months(i):
    return pr.trailing_twelve_months(i.fx_quarters)


@query("year_ago_balances", f"""
WITH {NEWEST5}
SELECT a.cik, a.end_date AS as_of, DAYS(a.end_date, b.end_date) AS gap_days,
  CASE WHEN DAYS(a.end_date, b.end_date) BETWEEN 330 AND 400 THEN b.stockholders_equity END AS prior_equity,
  CASE WHEN DAYS(a.end_date, b.end_date) BETWEEN 330 AND 400 THEN b.total_assets END AS prior_assets
FROM top a LEFT JOIN top b ON a.cik = b.cik AND b.n = 5 WHERE a.n = 1
""")
def year_ago_balances(i):
    return pr.year_ago_prior(i.fx_quarters)


LATEST = [*pr.TTM_FLOWS, *pr.TTM_BALANCES]


@query("latest_quarter", f"""
WITH {NEWEST5},
a AS (SELECT x.*, DAYS(x.end_date, y.end_date) AS gap, DAYS(x.end_date, z.end_date) AS ygap, z.stockholders_equity AS eq5, z.total_assets AS as5
  FROM top x LEFT JOIN top y ON x.cik = y.cik AND y.n = 2 LEFT JOIN top z ON x.cik = z.cik AND z.n = 5 WHERE x.n = 1),
b AS (SELECT *, CASE WHEN gap BETWEEN 75 AND 110 THEN 'ok' WHEN gap IS NOT NULL THEN 'cadence_check_failed' WHEN form = '10-Q' THEN 'ok' ELSE 'single_period' END AS status,
  coalesce(CASE WHEN quality = 'standalone' THEN eps_diluted END, net_income / shares_outstanding) AS eps FROM a)
SELECT cik, status, fy, fiscal_period, form, end_date, quality, {', '.join(f"CASE WHEN status = 'ok' THEN {'abs(' + m + ')' if m == 'capital_expenditures' else m} END AS {m}" for m in LATEST)},
  CASE WHEN status = 'ok' THEN eps END AS eps_diluted, CASE WHEN status = 'ok' THEN stockholders_equity END AS total_equity,
  CASE WHEN status = 'ok' THEN total_debt - coalesce(cash_and_equivalents, 0) END AS net_debt,
  CASE WHEN status = 'ok' AND ygap BETWEEN 330 AND 400 THEN eq5 END AS prior_equity, CASE WHEN status = 'ok' AND ygap BETWEEN 330 AND 400 THEN as5 END AS prior_assets
FROM b
""")
def latest_quarter(i):
    return pr.latest_quarter(i.fx_quarters)


@query("yoy_comparison", """
SELECT cik, metric, fy, end_date, value, lag(value) OVER (PARTITION BY cik, metric ORDER BY end_date) AS yoy_prior FROM fx_long
""")
def yoy_comparison(i):
    return pr.compare_periods(i.fx_long)


@query("qoq_comparison", """
SELECT cik, end_date, value, lag(value, 4) OVER w AS yoy_prior, lag(value, 1) OVER w AS qoq_prior FROM (
  SELECT cik, end_date, operating_cash_flow - abs(capital_expenditures) AS value FROM fx_quarters) t
WINDOW w AS (PARTITION BY cik ORDER BY end_date)
""")
def qoq_comparison(i):
    fcf = i.fx_quarters.select(
        "cik", "end_date", (F.col("operating_cash_flow") - F.abs("capital_expenditures")).alias("value")
    )
    return pr.compare_periods(fcf, quarterly=True, keys=("cik",))


@query("newest_periods", """
SELECT cik, fy, revenue, n FROM (SELECT cik, fy, revenue, cast(row_number() OVER (PARTITION BY cik ORDER BY end_date DESC) AS int) AS n FROM fx_wide) t WHERE n <= 4
""")
def newest_periods(i):
    return pr.newest_periods(i.fx_wide, 4).select("cik", "fy", "revenue", "n")


@query("period_overlay", f"""
WITH t AS ({TTM_SQL.strip()}),
a AS (SELECT * FROM (SELECT cik, fy, revenue, net_income, total_assets, row_number() OVER (PARTITION BY cik ORDER BY fy DESC) AS rn FROM fx_wide) x WHERE rn = 1)
SELECT a.cik, a.fy, CASE WHEN t.status = 'ok' THEN t.revenue ELSE a.revenue END AS revenue, CASE WHEN t.status = 'ok' THEN t.net_income ELSE a.net_income END AS net_income,
  CASE WHEN t.status = 'ok' THEN t.total_assets ELSE a.total_assets END AS total_assets, CASE WHEN t.status = 'ok' THEN 'ttm' ELSE 'annual_fallback' END AS basis
FROM a LEFT JOIN t ON a.cik = t.cik
""")
def period_overlay(i):
    metrics = ["revenue", "net_income", "total_assets"]
    annual = pr.newest(i.fx_wide.select("cik", "fy", "end_date", *metrics), 1).drop("n", "end_date")
    return pr.overlay(annual, pr.trailing_twelve_months(i.fx_quarters), metrics, "ttm")


@query("fiscal_labels", """
SELECT cik, accn, form, CASE WHEN cik % 3 = 0 THEN year(report_date) WHEN form IN ('10-K', '20-F', '40-F') AND month(filed) <= 3 THEN year(filed) - 1 ELSE year(filed) END::int AS fiscal_year,
  CASE WHEN form IN ('10-Q', '6-K') THEN 'quarterly' ELSE 'annual' END AS period_type,
  form IN ('10-Q', '6-K') AND quarter(report_date) IN (2, 3) AS is_ytd,
  CASE quarter(report_date) WHEN 1 THEN 'Q1 (Standalone)' WHEN 2 THEN 'Q2 (6-month YTD)' WHEN 3 THEN 'Q3 (9-month YTD)' ELSE 'Q4' END AS label
FROM fx_filings WHERE report_date IS NOT NULL
""")
def fiscal_labels(i):
    f = i.fx_filings.where("report_date IS NOT NULL")
    known = F.when(F.col("cik") % 3 == 0, F.col("report_date"))
    fp = F.concat(F.lit("Q"), F.quarter("report_date").cast("string"))
    return f.select(
        "cik", "accn", "form",
        d.fiscal_year(F.lit(None), known, F.col("filed"), F.col("form")).alias("fiscal_year"),
        d.period_kind(F.col("form")).alias("period_type"),
        d.is_year_to_date(F.col("form"), fp).alias("is_ytd"),
        d.quarter_label(fp).alias("label"),
    )
