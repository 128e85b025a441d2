"""Ratios, valuation, validation and presentation of wide metrics."""

from pyspark.sql import functions as F

from ledgerline.catalog.metrics import INDUSTRY
from ledgerline.catalog.registry import query
from ledgerline.functions import checks as ck
from ledgerline.functions import ratios as rt
from ledgerline.functions.labels import industry_class
from ledgerline.functions.numeric import confidence_of, growth, money_text, safe_num

EQ = "coalesce(nullif(stockholders_equity, 0), total_equity)"
DEBT = "CASE WHEN long_term_debt IS NOT NULL OR short_term_debt IS NOT NULL THEN coalesce(long_term_debt, 0) + coalesce(short_term_debt, 0) END"
PRIOR = f"""w AS (SELECT x.*, {EQ} AS eq, {DEBT} AS debt, lag(stockholders_equity) OVER p AS prior_equity, lag(total_assets) OVER p AS prior_assets
  FROM fx_wide x WINDOW p AS (PARTITION BY cik ORDER BY fy))"""
RATE = "CASE WHEN income_before_tax > 0 AND income_tax_expense >= 0 AND income_tax_expense / income_before_tax <= 0.5 THEN income_tax_expense / income_before_tax END"
CAPITAL = "(debt + eq - coalesce(cash_and_equivalents, 0))"
NOPAT = f"(coalesce(operating_income, income_before_tax + abs(interest_expense)) * (1 - coalesce({RATE}, 0.21::double)))"
ROIC = f"CASE WHEN {CAPITAL} > 0 THEN {NOPAT} / {CAPITAL} END"


def _prior(i):
    from pyspark.sql import Window
    w = Window.partitionBy("cik").orderBy("fy")
    return i.fx_wide.withColumns({
        "prior_equity": F.lag("stockholders_equity").over(w), "prior_assets": F.lag("total_assets").over(w),
    })


@query("ratios", f"""
WITH {PRIOR}
SELECT cik, fy, gross_profit / nullif(revenue, 0) AS gross_margin, operating_income / nullif(revenue, 0) AS operating_margin, net_income / nullif(revenue, 0) AS net_margin,
  net_income / nullif(CASE WHEN total_assets > 0 AND prior_assets > 0 THEN (total_assets + prior_assets) / 2 ELSE total_assets END, 0) AS return_on_assets,
  CASE WHEN eq > 0 THEN net_income / CASE WHEN prior_equity > 0 THEN (eq + prior_equity) / 2 ELSE eq END END AS return_on_equity,
  CASE WHEN eq > 0 THEN net_income / CASE WHEN prior_equity > 0 THEN (eq + prior_equity) / 2 ELSE eq END END AS roe,
  CASE WHEN eq > 0 AND net_income IS NOT NULL THEN CASE WHEN prior_equity > 0 THEN 'avg' ELSE 'ending' END END AS roe_basis,
  {ROIC} AS roic,
  CASE WHEN ({ROIC}) IS NULL THEN NULL WHEN operating_income IS NULL THEN 'ebit_proxy' WHEN ({RATE}) IS NOT NULL THEN 'oi_effective_tax' ELSE 'oi_statutory_tax' END AS roic_basis,
  {RATE} AS effective_tax_rate, current_assets / nullif(current_liabilities, 0) AS current_ratio,
  CASE WHEN eq > 0 THEN debt / eq END AS debt_to_equity, debt / nullif(total_assets, 0) AS debt_to_assets, CASE WHEN eq > 0 THEN total_liabilities / eq END AS liabilities_to_equity,
  ebitda / nullif(revenue, 0) AS ebitda_margin, free_cash_flow / nullif(revenue, 0) AS fcf_margin, operating_cash_flow / nullif(net_income, 0) AS ocf_to_net_income
FROM w
""")
def ratios(i):
    return rt.with_ratios(_prior(i), "prior_equity", "prior_assets").select("cik", "fy", *rt.RATIOS)


@query("effective_tax_rate", f"SELECT cik, fy, {RATE} AS rate FROM fx_wide")
def effective_tax_rate(i):
    return i.fx_wide.select("cik", "fy", rt.effective_tax_rate(F.col("income_tax_expense"), F.col("income_before_tax")).alias("rate"))


@query("return_on_invested_capital", f"""
WITH {PRIOR} SELECT cik, fy, {ROIC} AS roic,
 CASE WHEN ({ROIC}) IS NULL THEN NULL WHEN operating_income IS NULL THEN 'ebit_proxy' WHEN ({RATE}) IS NOT NULL THEN 'oi_effective_tax' ELSE 'oi_statutory_tax' END AS roic_basis FROM w
""")
def return_on_invested_capital(i):
    value, basis = rt.roic(rt._Row(i.fx_wide))
    return i.fx_wide.select("cik", "fy", value.alias("roic"), basis.alias("roic_basis"))


@query("percent_ratios", f"""
WITH {PRIOR} SELECT cik, fy, net_income / nullif(revenue, 0) * 100 AS net_margin, current_assets / nullif(current_liabilities, 0) AS current_ratio,
 ({RATE}) * 100 AS effective_tax_rate FROM w
""")
def percent_ratios(i):
    return rt.to_percent(rt.with_ratios(i.fx_wide)).select("cik", "fy", "net_margin", "current_ratio", "effective_tax_rate")


@query("not_applicable_metrics", f"""
WITH c AS (SELECT cik, {INDUSTRY} AS industry FROM fx_company)
SELECT cik, industry, CASE industry WHEN 'bank' THEN 'current_ratio,ebitda_margin,ev_ebitda,ev_to_revenue,fcf_margin,free_cash_flow,gross_margin,price_to_fcf,roic'
  WHEN 'insurance' THEN 'current_ratio,ebitda_margin,ev_ebitda,gross_margin,roic' WHEN 'reit' THEN 'current_ratio,gross_margin' WHEN 'utility' THEN 'current_ratio' ELSE '' END AS hidden,
 CASE industry WHEN 'reit' THEN 'currentRatio,grossMargin' WHEN 'utility' THEN 'currentRatio' WHEN 'insurance' THEN 'currentRatio,ebitdaMargin,evEbitda,grossMargin,roic'
  WHEN 'bank' THEN 'currentRatio,ebitdaMargin,evEbitda,evToRevenue,fcfMargin,freeCashFlow,grossMargin,priceToFcf,roic' ELSE '' END AS hidden_camel FROM c
""")
def not_applicable_metrics(i):
    c = i.fx_company.select("cik", industry_class("sic").alias("industry"))
    return c.select(
        "cik", "industry", F.array_join(rt.not_applicable(F.col("industry")), ",").alias("hidden"),
        F.array_join(rt.not_applicable(F.col("industry"), camel=True), ",").alias("hidden_camel"),
    )


VALUATION = """market_cap total_debt net_debt net_debt_basis enterprise_value pe_ratio pe_basis ps_ratio pb_ratio ev_ebitda ev_to_revenue price_to_fcf""".split()
VALUE_SQL = f"""
v AS (SELECT w.*, price, {EQ} AS eq, {DEBT} AS total_debt, CASE WHEN price <> 0 AND shares_outstanding <> 0 THEN price * shares_outstanding END AS market_cap
  FROM fx_wide w LEFT JOIN fx_prices p ON w.cik = p.cik),
u AS (SELECT *, CASE WHEN total_debt IS NOT NULL THEN total_debt - coalesce(cash_and_equivalents, 0) ELSE -cash_and_equivalents END AS net_debt,
  CASE WHEN total_debt IS NOT NULL AND cash_and_equivalents IS NOT NULL THEN 'debt_and_cash' WHEN total_debt IS NOT NULL THEN 'debt_only' WHEN cash_and_equivalents IS NOT NULL THEN 'cash_only' END AS net_debt_basis,
  CASE WHEN eps_diluted > 0 THEN price / eps_diluted END AS pe1, CASE WHEN net_income > 0 THEN market_cap / net_income END AS pe2 FROM v),
t AS (SELECT *, market_cap + net_debt AS enterprise_value, pe2 IS NOT NULL AND (pe1 IS NULL OR pe1 / pe2 > 1.8 OR pe2 / pe1 > 1.8) AS sw FROM u),
valued AS (SELECT *, CASE WHEN sw THEN pe2 ELSE pe1 END AS pe_ratio, CASE WHEN sw THEN 'mcap_ni' WHEN pe1 IS NOT NULL THEN 'eps' END AS pe_basis,
  CASE WHEN revenue > 0 THEN market_cap / revenue END AS ps_ratio, CASE WHEN eq > 0 THEN market_cap / eq END AS pb_ratio, CASE WHEN ebitda > 0 THEN enterprise_value / ebitda END AS ev_ebitda,
  CASE WHEN revenue > 0 THEN enterprise_value / revenue END AS ev_to_revenue, CASE WHEN free_cash_flow > 0 THEN market_cap / free_cash_flow END AS price_to_fcf FROM t)"""


@query("valuation", f"WITH {VALUE_SQL} SELECT cik, fy, price, {', '.join(VALUATION)} FROM valued")
def valuation(i):
    return rt.with_valuation(i.fx_wide.join(i.fx_prices, "cik", "left")).select("cik", "fy", "price", *VALUATION)


@query("bank_margin_proxy", f"""
WITH {PRIOR} SELECT cik, fy, interest_expense / nullif(CASE WHEN prior_assets <> 0 THEN (total_assets + prior_assets) / 2 ELSE total_assets END, 0) * 100 AS nim_proxy,
  operating_income / nullif(revenue, 0) * 100 AS fee_share FROM w
""")
def bank_margin_proxy(i):
    c = F.col
    block = rt.bank_block(c("interest_expense"), c("operating_income"), c("revenue"), c("total_assets"), c("prior_assets"))
    return _prior(i).select("cik", "fy", *[v.alias(k) for k, v in block.items()])


GAP = "CASE WHEN total_assets IS NOT NULL AND total_liabilities IS NOT NULL AND stockholders_equity IS NOT NULL THEN CASE WHEN total_assets = 0 THEN 0 ELSE abs(total_assets - (total_liabilities + stockholders_equity + coalesce(minority_interest, 0))) / total_assets END END"
REPAIR = f"""g AS (SELECT *, {GAP} AS gap_before, total_assets - total_liabilities AS de, total_assets - stockholders_equity AS dl FROM fx_wide),
r AS (SELECT *, CASE WHEN gap_before IS NULL OR gap_before <= 0.05 THEN NULL
  WHEN de > 0 AND abs(de - stockholders_equity) / greatest(abs(stockholders_equity), 1) > 0.05 AND de / total_assets > 0.01 AND de / total_assets < 0.9 THEN 'equity_from_difference'
  WHEN abs(total_liabilities - total_assets) / greatest(abs(total_assets), 1) < 0.02 AND dl > 0 THEN 'liabilities_were_total'
  WHEN minority_interest > 0 AND abs(total_assets - (total_liabilities + stockholders_equity + minority_interest)) / greatest(abs(total_assets), 1) < 0.05 THEN 'minority_added'
  WHEN abs(total_assets - (dl + stockholders_equity)) / greatest(abs(total_assets), 1) < abs(total_assets - (total_liabilities + stockholders_equity)) / greatest(abs(total_assets), 1) AND dl > 0 THEN 'liabilities_from_difference' END AS repair FROM g),
f AS (SELECT * REPLACE (CASE repair WHEN 'equity_from_difference' THEN de WHEN 'minority_added' THEN stockholders_equity + minority_interest ELSE stockholders_equity END AS stockholders_equity,
  CASE WHEN repair IN ('liabilities_were_total', 'liabilities_from_difference') THEN dl ELSE total_liabilities END AS total_liabilities) FROM r),
fixed AS (SELECT *, {GAP} AS gap_after FROM f)"""


@query("repair_balance_sheet", f"WITH {REPAIR} SELECT cik, fy, repair, stockholders_equity, total_liabilities, gap_before, gap_after FROM fixed")
def repair_balance_sheet(i):
    return ck.repair_balance(i.fx_wide).select("cik", "fy", "repair", "stockholders_equity", "total_liabilities", "gap_before", "gap_after")


RULES_SQL = [
    ("revenue_gt_net_income", "error", "revenue > 0 AND net_income > 0 AND net_income > revenue"),
    ("accounting_equation_repaired", "info", "gap_before > 0.05 AND repair IS NOT NULL AND gap_after <= 0.05"),
    ("accounting_equation", "warning", "gap_before > 0.05 AND NOT (repair IS NOT NULL AND gap_after <= 0.05)"),
    ("bank_revenue_segment", "error", "industry = 'bank' AND revenue > 0 AND net_income > 0 AND revenue < net_income * 0.8"),
    ("gross_margin_range", "warning", "industry = 'standard' AND revenue > 0 AND (gross_profit / revenue < 0 OR gross_profit / revenue > 1)"),
    ("net_margin_extreme", "warning", "revenue > 0 AND abs(net_income / revenue) > 1"),
    ("gross_profit_identity", "warning", "revenue <> 0 AND abs(gross_profit - (revenue - abs(cost_of_revenue))) / greatest(abs(revenue), 1) > 0.02"),
    ("pretax_tax_tie", "info", "income_before_tax <> 0 AND abs(net_income - (income_before_tax - income_tax_expense)) / greatest(abs(income_before_tax), 1) > 0.05"),
    ("revenue_missing", "warning", "revenue IS NULL"), ("net_income_missing", "warning", "net_income IS NULL"),
]


@query("validate_metrics", f"""
WITH {REPAIR}, k AS (SELECT cik AS ccik, {INDUSTRY} AS industry FROM fx_company), z AS (SELECT * FROM fixed JOIN k ON cik = ccik)
{' UNION ALL '.join(f"SELECT cik, fy, '{n}' AS rule, '{s}' AS severity FROM z WHERE {c}" for n, s, c in RULES_SQL)}
""")
def validate_metrics(i):
    df = i.fx_wide.join(i.fx_company.select("cik", industry_class("sic").alias("industry")), "cik")
    out = ck.validate(ck.repair_balance(df))
    return out.select("cik", "fy", F.explode("warnings").alias("w")).select("cik", "fy", "w.rule", "w.severity")


@query("safe_numbers", """
SELECT cik, fy, CASE WHEN cik % 4 = 0 THEN NULL WHEN cik % 4 = 1 THEN NULL WHEN cik % 4 = 2 THEN NULL ELSE revenue END AS value FROM fx_wide
""")
def safe_numbers(i):
    raw = (
        F.when(F.col("cik") % 4 == 0, "n/a").when(F.col("cik") % 4 == 1, "NaN")
        .when(F.col("cik") % 4 == 2, "-Infinity").otherwise(F.col("revenue").cast("string"))
    )
    return i.fx_wide.select("cik", "fy", safe_num(raw).alias("value"))


def _short(unit, suffix):
    return f"CASE WHEN v < 0 THEN '-' ELSE '' END || '$' || format('{{:,}}', cast(floor(cast(abs(v) / {unit} AS decimal(28,2))) AS bigint)) || '.' || right('0' || cast(cast(cast(abs(v) / {unit} AS decimal(28,2)) * 100 AS bigint) % 100 AS varchar), 2) || '{suffix}'"


@query("money_text", f"""
WITH t AS (SELECT cik, fy, metric, CASE WHEN cik % 3 = 0 THEN value * 1000000 WHEN cik % 3 = 1 THEN -value ELSE value * 1000 END AS v FROM fx_long WHERE metric IN ('revenue', 'eps_diluted', 'total_assets'))
SELECT cik, fy, metric, CASE WHEN abs(v) >= 1e12 THEN {_short('1e12', 'T')} WHEN abs(v) >= 1e9 THEN {_short('1e9', 'B')} WHEN abs(v) >= 1e6 THEN {_short('1e6', 'M')}
  ELSE CASE WHEN v < 0 THEN '-' ELSE '' END || '$' || format('{{:,}}', cast(cast(abs(v) AS decimal(28,0)) AS bigint)) END AS text FROM t
""")
def money_texts(i):
    v = F.when(F.col("cik") % 3 == 0, F.col("value") * 1000000).when(F.col("cik") % 3 == 1, -F.col("value")).otherwise(F.col("value") * 1000)
    df = i.fx_long.where("metric IN ('revenue', 'eps_diluted', 'total_assets')").withColumn("v", v)
    return df.select("cik", "fy", "metric", money_text("v").alias("text"))


@query("growth", """
SELECT cik, metric, fy, (value - p) / nullif(abs(p), 0) AS growth FROM (SELECT *, lag(value) OVER (PARTITION BY cik, metric ORDER BY fy) AS p FROM fx_long) t WHERE p IS NOT NULL
""")
def growth_rates(i):
    from ledgerline.operators.periods import compare_periods
    df = compare_periods(i.fx_long).where("yoy_prior IS NOT NULL")
    return df.select("cik", "metric", "fy", growth("value", "yoy_prior").alias("growth"))


@query("combined_confidence", """
SELECT cik, fy, least(CASE WHEN gross_profit IS NULL THEN 0.0 ELSE 0.99 END, CASE WHEN operating_income IS NULL THEN 0.5 ELSE 0.85 END)::double * 0.9::double AS confidence FROM fx_wide
""")
def combined_confidence(i):
    a = F.when(F.col("gross_profit").isNull(), 0.0).otherwise(0.99)
    b = F.when(F.col("operating_income").isNull(), 0.5).otherwise(0.85)
    return i.fx_wide.select("cik", "fy", confidence_of(a, b, factor=0.9).alias("confidence"))


@query("statement_income_shape", """
SELECT cik, fy, end_date, revenue, cost_of_revenue AS "costOfRevenue", gross_profit AS "grossProfit", operating_expenses AS "operatingExpenses",
 depreciation_amortization AS "depreciationAndAmortization", ebitda, operating_income AS ebit, operating_income AS "operatingIncome", interest_expense AS "interestExpense",
 income_before_tax AS "incomeBeforeTax", income_tax_expense AS "incomeTaxExpense", net_income AS "netIncome", net_income AS "bottomLineNetIncome", eps_diluted AS "epsDiluted",
 shares_outstanding AS "weightedAverageShsOut" FROM fx_wide
""")
def statement_income_shape(i):
    return ck.statement_shape(i.fx_wide, "income")


@query("statement_cashflow_shape", """
SELECT cik, fy, end_date, operating_cash_flow AS "operatingCashFlow", operating_cash_flow AS "netCashProvidedByOperatingActivities", -abs(capital_expenditures) AS "capitalExpenditure",
 free_cash_flow AS "freeCashFlow", NULL::double AS "commonDividendsPaid", NULL::double AS "netDividendsPaid", NULL::double AS "commonStockRepurchased" FROM fx_wide
""")
def statement_cashflow_shape(i):
    return ck.statement_shape(i.fx_wide, "cashflow")


@query("statement_balance_shape", """
SELECT cik, fy, end_date, cash_and_equivalents AS "cashAndCashEquivalents", current_assets AS "totalCurrentAssets", total_assets AS "totalAssets", short_term_debt AS "shortTermDebt",
 current_liabilities AS "totalCurrentLiabilities", long_term_debt AS "longTermDebt", total_liabilities AS "totalLiabilities", stockholders_equity AS "totalStockholdersEquity",
 coalesce(nullif(total_equity, 0), stockholders_equity) AS "totalEquity" FROM fx_wide
""")
def statement_balance_shape(i):
    return ck.statement_shape(i.fx_wide, "balance")


@query("metric_aliases", """
SELECT cik, fy, q, stockholders_equity AS total_equity, total_debt - coalesce(cash_and_equivalents, 0) AS net_debt FROM fx_quarters
""")
def metric_aliases(i):
    return ck.metric_aliases(i.fx_quarters).select("cik", "fy", "q", "total_equity", "net_debt")


@query("camel_projection", """
SELECT cik, fy, q, net_income AS "netIncome", operating_cash_flow AS "operatingCashFlow", eps_diluted AS "epsDiluted" FROM fx_quarters
""")
def camel_projection(i):
    return ck.camel_projection(i.fx_quarters, ("cik", "fy", "q"), ("net_income", "operating_cash_flow", "eps_diluted"))
