"""Metric resolution, periods, ratios and valuation."""

from pyspark.sql import functions as F

from ledgerline.catalog.registry import query
from ledgerline.functions import concepts as C
from ledgerline.functions.labels import classify, industry_class
from ledgerline.operators import facts as fx
from ledgerline.operators import periods as pr
from ledgerline.operators import resolve as rs
from ledgerline.plans import fundamentals as plan


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


INDUSTRY = """CASE WHEN sic BETWEEN 6020 AND 6062 THEN 'bank' WHEN sic BETWEEN 6140 AND 6159 THEN 'bank'
 WHEN sic BETWEEN 6200 AND 6299 THEN 'bank' WHEN sic BETWEEN 6310 AND 6399 OR sic = 6411 THEN 'insurance'
 WHEN sic BETWEEN 6500 AND 6799 THEN 'reit' WHEN sic BETWEEN 4900 AND 4991 THEN 'utility' ELSE 'standard' END"""
DUR = "DAYS(end_date, start_date)"
SERIES = "cik, concept, taxonomy, units"

CLEAN = f"""clean AS (SELECT * FROM (SELECT *, {DUR} AS dur, row_number() OVER (PARTITION BY cik, concept, taxonomy, units, start_date, end_date
    ORDER BY filed DESC NULLS LAST, accn DESC NULLS LAST, value DESC NULLS LAST) AS dup FROM fx_facts
  WHERE dimension IS NULL AND concept NOT LIKE '%Axis' AND concept NOT LIKE '%TextBlock%'
    AND (units = 'shares' OR units = CASE WHEN cik % 10 = 9 THEN 'EUR' ELSE 'USD' END)) c WHERE dup = 1),
class AS (SELECT cik AS ccik, {INDUSTRY} AS industry FROM fx_company),
flagged AS (SELECT *, max(CASE WHEN dur BETWEEN 340 AND 400 THEN 1 ELSE 0 END) OVER (PARTITION BY {SERIES}) AS has_fy,
  row_number() OVER (PARTITION BY {SERIES}, end_date ORDER BY dur DESC, start_date) AS longest FROM clean),
annual AS (SELECT f.*, industry FROM flagged f JOIN class ON cik = ccik
  WHERE dur IS NULL OR (has_fy = 1 AND dur BETWEEN 340 AND 400) OR (has_fy = 0 AND longest = 1))"""

RULES = "rules(metric, ind, priority, tag, display, agg) AS (VALUES " + ", ".join(
    f"({_q(r.metric)}, {_q(r.industry)}, {r.priority}, {_q(r.tag)}, {_q(r.display)}, {1 if r.aggregate else 0})"
    for r in C.default_rules()
) + ")"
FORECAST = "(" + " OR ".join(f"lower(concept) LIKE '%{w.lower()}%'" for w in C.FORECAST_WORDS) + ")"

RESOLVED = f"""{CLEAN}, {RULES},
hits AS (SELECT a.cik, a.end_date, r.metric, r.priority, r.agg, a.value, r.display, a.concept = r.tag AS direct,
    a.concept, r.tag FROM annual a JOIN rules r ON regexp_extract(a.concept, '([^:_]+)$', 1) = r.tag AND (r.ind = '*' OR r.ind = a.industry)),
cand AS (SELECT cik, end_date, metric, CASE WHEN agg = 1 THEN 4 ELSE 1 END AS step, priority, 0.0 AS size, value, display FROM hits h
    WHERE direct OR NOT EXISTS (SELECT 1 FROM hits d WHERE d.direct AND d.cik = h.cik AND d.tag = h.tag)
  UNION ALL SELECT cik, end_date, 'revenue', 3, 0, -abs(value), value,
    CASE WHEN industry = 'bank' THEN 'Custom Net Revenue (' ELSE 'Custom Revenue (' END || concept || ')' FROM annual
    WHERE NOT {FORECAST} AND ((industry = 'bank' AND regexp_matches(concept, '(?i)(NetRevenue|TotalNetRevenue|_NetRevenues$)'))
      OR (industry <> 'bank' AND regexp_matches(concept, '(?i)(_Revenues$|_Revenue$|_TotalRevenue$|_TotalRevenues$)')))),
best AS (SELECT c.*, industry, row_number() OVER (PARTITION BY cik, end_date, metric ORDER BY step, priority, size, display) AS rn,
    FROM cand c JOIN class ON cik = ccik WHERE step < 4),
parts AS (SELECT cik, end_date, metric, sum(cast(value AS decimal(28,4)))::double AS value, string_agg(display, ' + ' ORDER BY priority) AS source,
    least(0.85, 0.60 + 0.05 * count(*))::double AS confidence FROM cand WHERE step = 4 GROUP BY cik, end_date, metric),
resolved AS (SELECT cik, end_date, metric, value, display AS source,
    CASE WHEN step = 1 THEN 0.99 WHEN industry = 'bank' THEN 0.85 ELSE 0.80 END::double AS confidence,
    CASE WHEN step = 1 THEN 'exact' ELSE 'custom_ext' END AS method FROM best WHERE rn = 1
  UNION ALL SELECT cik, end_date, metric, value, source, confidence, 'aggregate' FROM parts p
    WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.cik = p.cik AND b.end_date = p.end_date AND b.metric = p.metric))"""


def _industry(i):
    return i.fx_company.select("cik", industry_class("sic", "ticker").alias("industry"))


def _annual(i):
    return rs.with_industry(fx.annual_facts(fx.clean_facts(i.fx_facts)), _industry(i))


@query("resolve_metrics", f"WITH {RESOLVED} SELECT * FROM resolved")
def resolve_metrics(i):
    return rs.resolve_metrics(_annual(i))


@query("aggregate_fallback_metrics", f"WITH {RESOLVED} SELECT cik, end_date, metric, value, source, confidence FROM resolved WHERE method = 'aggregate'")
def aggregate_fallback_metrics(i):
    return rs.resolve_metrics(_annual(i)).where("method = 'aggregate'").drop("method")


@query("custom_revenue_tags", f"""
SELECT DISTINCT concept, NOT {FORECAST} AND regexp_matches(concept, '(?i)(_Revenues$|_Revenue$|_TotalRevenue$|_TotalRevenues$)') AS custom_revenue,
  NOT {FORECAST} AND regexp_matches(concept, '(?i)(NetRevenue|TotalNetRevenue|_NetRevenues$)') AS custom_net_revenue FROM fx_facts
""")
def custom_revenue_tags(i):
    c = F.col("concept")
    return i.fx_facts.select("concept").distinct().select(
        c, rs.is_custom_revenue(c).alias("custom_revenue"), rs.is_custom_net_revenue(c).alias("custom_net_revenue")
    )


def _tag(t):
    return f"max(CASE WHEN concept = '{t}' THEN value END)"


@query("depreciation_total", f"""
WITH {CLEAN}, t AS (SELECT cik, end_date, {_tag('DepreciationDepletionAndAmortization')} AS a, {_tag('DepreciationAndAmortization')} AS b,
   {_tag('Depreciation')} AS d, {_tag('AmortizationOfIntangibleAssets')} AS e FROM annual GROUP BY cik, end_date)
SELECT cik, end_date, coalesce(greatest(abs(a), abs(b)), abs(d) + abs(coalesce(e, 0))) AS da_total FROM t
WHERE coalesce(a, b, d) IS NOT NULL
""")
def depreciation_total(i):
    tags = rs.pivot_tags(_annual(i))
    return tags.select("cik", "end_date", rs.depreciation_total(tags).alias("da_total")).where("da_total IS NOT NULL")


@query("current_assets_rollup", f"""
WITH {CLEAN}, t AS (SELECT cik, end_date, sum(cast(value AS decimal(28,4)))::double AS total, count(*) AS components FROM annual
  WHERE concept IN ('CashAndCashEquivalentsAtCarryingValue','ShortTermInvestments','AccountsReceivableNetCurrent','InventoryNet',
   'PrepaidExpenseAndOtherAssetsCurrent','OtherAssetsCurrent') GROUP BY cik, end_date)
SELECT cik, end_date, total, cast(components AS int) AS components FROM t WHERE components >= 2
""")
def current_assets_rollup(i):
    total, n = rs.current_assets_rollup()
    return rs.pivot_tags(_annual(i)).select("cik", "end_date", total.alias("total"), n.alias("components")).where("components >= 2")


def _pv(m, what="value"):
    return f"max(CASE WHEN metric = '{m}' THEN {what} END)"


_WIDE = "revenue cost_of_revenue gross_profit operating_income operating_expenses net_income income_tax_expense interest_expense " \
    "depreciation_amortization operating_cash_flow capital_expenditures total_assets current_assets total_liabilities " \
    "stockholders_equity long_term_debt short_term_debt cash_and_equivalents".split()


@query("derived_metrics", f"""
WITH {RESOLVED},
w AS (SELECT cik, end_date, {', '.join(f'{_pv(m)} AS {m}' for m in _WIDE)}, {_pv('revenue', 'confidence')} AS rc, {_pv('cost_of_revenue', 'confidence')} AS cc
  FROM resolved GROUP BY cik, end_date),
t AS (SELECT cik AS tcik, end_date AS tend, {_tag('DepreciationDepletionAndAmortization')} AS a, {_tag('DepreciationAndAmortization')} AS b,
   {_tag('Depreciation')} AS d, {_tag('AmortizationOfIntangibleAssets')} AS e, {_tag('PaymentsToAcquireEquipmentOnLease')} AS lease,
   {_tag('CashAndCashEquivalentsAtCarryingValue')} + {_tag('AccountsReceivableNetCurrent')} AS ca,
   greatest({_tag('Revenues')}, {_tag('RevenueFromContractWithCustomerExcludingAssessedTax')}) AS broad FROM annual GROUP BY cik, end_date),
s1 AS (SELECT *, coalesce(greatest(abs(a), abs(b)), abs(d) + abs(coalesce(e, 0))) AS da, revenue - abs(cost_of_revenue) AS gp,
   CASE WHEN lease > 0 THEN capital_expenditures + lease ELSE capital_expenditures END AS capex FROM w JOIN t ON cik = tcik AND end_date = tend)
SELECT cik, end_date, CASE WHEN net_income > revenue AND revenue > 0 AND broad > revenue THEN broad ELSE revenue END AS revenue,
  coalesce(gross_profit, gp) AS gross_profit,
  CASE WHEN gross_profit IS NULL AND gp IS NOT NULL THEN least(rc, cc) * 0.9 END AS gross_profit_confidence,
  round(cast(coalesce(current_assets, cast(ca AS decimal(28,4))::double) AS decimal(28,4)), 2)::double AS current_assets,
  coalesce(operating_income, gp - abs(operating_expenses)) AS operating_income,
  coalesce(total_liabilities, total_assets - stockholders_equity) AS total_liabilities,
  capex AS capital_expenditures, operating_cash_flow - abs(capex) AS free_cash_flow,
  CASE WHEN long_term_debt IS NOT NULL OR short_term_debt IS NOT NULL THEN coalesce(long_term_debt, 0) + coalesce(short_term_debt, 0) END AS total_debt,
  CASE WHEN long_term_debt IS NOT NULL OR short_term_debt IS NOT NULL THEN coalesce(long_term_debt, 0) + coalesce(short_term_debt, 0) - coalesce(cash_and_equivalents, 0) END AS net_debt,
  greatest(abs(depreciation_amortization), da) AS depreciation_amortization,
  coalesce(net_income + abs(coalesce(interest_expense, 0)) + coalesce(income_tax_expense, 0) + abs(da), operating_income + da) AS ebitda,
  CASE WHEN net_income IS NULL OR da IS NULL THEN 0.0 WHEN interest_expense IS NOT NULL AND income_tax_expense IS NOT NULL THEN 0.85 ELSE 0.70 END::double AS ebitda_confidence
FROM s1
""")
def derived_metrics(i):
    df = rs.extract(fx.annual_facts(fx.clean_facts(i.fx_facts)), industry=_industry(i))
    return df.select(
        "cik", "end_date", "revenue", "gross_profit",
        F.when(F.col("gross_profit__src").startswith("Computed"), F.col("gross_profit__conf")).alias("gross_profit_confidence"),
        "current_assets", "operating_income", "total_liabilities", "capital_expenditures", "free_cash_flow",
        "total_debt", "net_debt", "depreciation_amortization", "ebitda", F.col("ebitda__conf").alias("ebitda_confidence"),
    )


@query("convert_currency", """
SELECT l.cik, l.fy, l.metric, c.currency, CASE WHEN c.currency = 'USD' OR l.metric = 'shares_outstanding' THEN l.value ELSE l.value * 1.1 END AS value,
  CASE WHEN c.currency = 'USD' THEN 1.0 ELSE 1.1 END::double AS fx_rate
FROM fx_long l JOIN fx_company c ON l.cik = c.cik
""")
def convert_currency(i):
    long = i.fx_long.join(i.fx_company.select("cik", "currency"), "cik").select("cik", "fy", "metric", "currency", "value")
    return rs.convert_currency(long, i.fx_rates)


@query("convert_currency_by_inverse", """
SELECT cik, fy, metric, CASE cik % 3 WHEN 0 THEN 'JPY' WHEN 1 THEN 'CHF' ELSE 'EUR' END AS currency,
  CASE cik % 3 WHEN 0 THEN value * (1 / cast(150 AS double)) WHEN 1 THEN value ELSE value * cast(1.1 AS double) END AS value,
  CASE cik % 3 WHEN 0 THEN 1 / cast(150 AS double) WHEN 1 THEN NULL ELSE cast(1.1 AS double) END AS fx_rate
FROM fx_long WHERE metric IN ('revenue', 'eps_diluted')
""")
def convert_currency_by_inverse(i):
    ccy = F.when(F.col("cik") % 3 == 0, "JPY").when(F.col("cik") % 3 == 1, "CHF").otherwise("EUR")
    long = i.fx_long.where("metric IN ('revenue', 'eps_diluted')").withColumn("currency", ccy)
    return rs.convert_currency(long.select("cik", "fy", "metric", "currency", "value"), i.fx_rates)


@query("resolver_diff", """
WITH a AS (SELECT cik, fy, metric, value FROM fx_long WHERE metric <> 'ebitda' OR cik % 2 = 0),
b AS (SELECT cik, fy, metric, value * (CASE WHEN cik % 5 = 0 THEN 1.01 WHEN cik % 5 = 1 THEN 1.0005 ELSE 1 END)::double AS value FROM fx_long WHERE metric <> 'revenue' OR cik % 7 <> 0),
j AS (SELECT coalesce(a.cik, b.cik) AS cik, coalesce(a.fy, b.fy) AS fy, coalesce(a.metric, b.metric) AS metric, a.value AS left_value, b.value AS right_value
  FROM a FULL OUTER JOIN b ON a.cik = b.cik AND a.fy = b.fy AND a.metric = b.metric),
k AS (SELECT *, CASE WHEN left_value <> 0 AND right_value IS NOT NULL THEN abs(left_value - right_value) / greatest(abs(left_value), 1e-9) END AS rel_diff FROM j)
SELECT * FROM k WHERE (rel_diff IS NULL OR rel_diff >= 0.001) AND coalesce(left_value, right_value) IS NOT NULL
""")
def resolver_diff(i):
    keys = ["cik", "fy", "metric"]
    long = i.fx_long.select(*keys, "value")
    nudge = F.when(F.col("cik") % 5 == 0, 1.01).when(F.col("cik") % 5 == 1, 1.0005).otherwise(1.0)
    left = long.where("metric <> 'ebitda' OR cik % 2 = 0")
    right = long.where("metric <> 'revenue' OR cik % 7 <> 0").withColumn("value", F.col("value") * nudge)
    return rs.resolver_diff(left, right, keys)


@query("bank_revenue_drivers", f"""
WITH {CLEAN}, d AS (SELECT cik, end_date, {_tag('InterestIncomeExpenseNet')} AS nii, {_tag('NoninterestIncome')} AS non,
   {_tag('InvestmentBankingRevenue')} AS ib, {_tag('TradingGainsLosses')} AS trading, {_tag('NetIncomeLoss')} AS dummy FROM annual GROUP BY cik, end_date),
r AS (SELECT cik AS rcik, end_date AS rend, {_tag('Revenues')} AS total FROM annual GROUP BY cik, end_date),
x AS (SELECT cik, end_date, nii, non, ib, trading, coalesce(total, nii + non) AS total FROM d JOIN r ON cik = rcik AND end_date = rend WHERE nii IS NOT NULL OR non IS NOT NULL),
y AS (SELECT *, total - (nii + ib + trading) AS residual FROM x),
z AS (SELECT *, CASE WHEN residual > abs(total) * 0.005 THEN residual END AS plug FROM y),
rows_ AS (SELECT cik, end_date, total, 'net_interest_income' AS driver, 'Net Interest Income' AS label, nii AS value, nii, non, ib, trading, plug FROM z
 UNION ALL SELECT cik, end_date, total, 'investment_banking', 'Investment Banking', ib, nii, non, ib, trading, plug FROM z
 UNION ALL SELECT cik, end_date, total, 'trading_principal', 'Trading Revenue', trading, nii, non, ib, trading, plug FROM z
 UNION ALL SELECT cik, end_date, total, 'other_revenue', 'Other Fee Income', plug, nii, non, ib, trading, plug FROM z)
SELECT cik, end_date, total, driver, label, value, value / total AS share,
 abs(nii + ib + trading + coalesce(plug, 0) - total) <= abs(total) * 0.01 AS reconciles, abs(nii + non - total) <= abs(total) * 0.01 AS tier1_identity
FROM rows_ WHERE value IS NOT NULL
""")
def bank_revenue_drivers(i):
    view = _annual(i)
    totals = view.where("concept = 'Revenues'").groupBy("cik", "end_date").agg(F.max("value").alias("total_net_revenue"))
    df = rs.bank_revenue_drivers(view, totals)
    return df.withColumn("label", F.when(F.col("driver") == "trading_principal", "Trading Revenue").otherwise(F.col("label")))


@query("industry_class", f"SELECT cik, sic, {INDUSTRY} AS industry FROM fx_company")
def industry_classes(i):
    return i.fx_company.select("cik", "sic", industry_class("sic", "ticker").alias("industry"))


def _sector_sql():
    from ledgerline.functions.labels import SECTOR_RANGES
    rows = ", ".join(f"({n}, {lo}, {hi}, {_q(sector)}, {_q(industry)})" for n, (lo, hi, sector, industry) in enumerate(SECTOR_RANGES))
    return f"""
WITH r(n, lo, hi, s, d) AS (VALUES {rows}),
m AS (SELECT cik, s, d, row_number() OVER (PARTITION BY cik ORDER BY n) AS rn FROM fx_company JOIN r ON sic BETWEEN lo AND hi),
o AS (SELECT cik FROM fx_company WHERE fund)
SELECT c.cik, c.sic, CASE WHEN o.cik IS NOT NULL THEN 'Funds' ELSE coalesce(m.s, 'Other') END AS sector,
  CASE WHEN o.cik IS NOT NULL THEN 'Listed Fund' ELSE coalesce(m.d, 'Unknown') END AS industry,
  CASE WHEN o.cik IS NOT NULL THEN 'ticker' WHEN m.s IS NOT NULL THEN 'sic' ELSE 'fallback' END AS class_source
FROM fx_company c LEFT JOIN m ON c.cik = m.cik AND m.rn = 1 LEFT JOIN o ON c.cik = o.cik"""


@query("classify_sector", _sector_sql())
def classify_sector(i):
    own = i.fx_company.where("fund").select("ticker", F.lit("Funds").alias("sector"), F.lit("Listed Fund").alias("industry"))
    return classify(i.fx_company.select("cik", "ticker", "sic"), own).drop("ticker")


PARTS = " + ".join(f"cast(revenue * {w} AS decimal(18,2))" for w in (0.6, 0.4, 0.2, 0.1))
REVENUE_2001 = f"""CASE WHEN industry = 'bank' AND (cik % 16 = 0 OR cik % 5 = 0) THEN CASE WHEN cik % 3 = 1 THEN {PARTS} END
  WHEN industry = 'insurance' AND cik % 5 = 0 AND cik % 16 <> 0 THEN CASE WHEN cik % 9 = 0 THEN cast(revenue * 0.9 AS decimal(18,2)) END
  WHEN cik % 32 = 0 THEN cast(revenue * 0.95 AS decimal(18,2)) WHEN cik % 16 = 0 THEN cast(revenue * 0.9 AS decimal(18,2))
  WHEN cik % 7 = 0 THEN cast(revenue * 1.01 AS decimal(18,2)) ELSE revenue END"""


@query("trailing_profitability", f"""
WITH y AS (SELECT cik, fy, end_date, ({REVENUE_2001})::double AS revenue, net_income::double AS net_income,
    cast(cum * 0.8 AS decimal(18,2))::double AS equity FROM fx_ytd JOIN (SELECT cik AS ccik, {INDUSTRY} AS industry FROM fx_company) k ON cik = ccik WHERE q = 4 AND cik % 13 <> 0),
t AS (SELECT a.*, b.equity AS prior_equity FROM y a LEFT JOIN y b ON a.cik = b.cik AND a.fy = b.fy + 1 WHERE a.fy = 2001)
SELECT cik, 'ok' AS status, end_date AS as_of, 'ttm_sum_4q' AS quality, revenue, net_income, net_income / revenue AS net_margin,
  net_income / ((equity + prior_equity) / 2) AS roe, 'avg' AS roe_basis FROM t WHERE revenue IS NOT NULL
UNION ALL SELECT DISTINCT cik, 'too_few_quarters', NULL::date, NULL, NULL::double, NULL::double, NULL::double, NULL::double, NULL FROM fx_ytd WHERE cik % 13 = 0
""")
def trailing_profitability(i):
    return plan.trailing_profitability(i.fx_facts, _industry(i))
