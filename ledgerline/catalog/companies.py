"""Lookup, search, screens, filing lists, peers and comparisons."""

from pyspark.sql import functions as F

from ledgerline.catalog.metrics import INDUSTRY
from ledgerline.catalog.ratios import VALUE_SQL
from ledgerline.catalog.registry import query
from ledgerline.functions import checks as ck
from ledgerline.functions import labels as lb
from ledgerline.functions import ratios as rt
from ledgerline.operators import compare as cp
from ledgerline.operators import entities as en
from ledgerline.operators import ranking as rk
from ledgerline.operators import screen as sc
from ledgerline.operators import text as tx

NEWEST = "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY fy DESC) AS rn FROM fx_wide) x WHERE rn = 1)"


def _newest(i):
    return rk.top_per_group(i.fx_wide, ["cik"], [F.col("fy").desc()], 1).drop("rn")


@query("resolve_entity", """
WITH r AS (SELECT DISTINCT q FROM (SELECT ticker AS q FROM fx_company UNION ALL SELECT left(ticker, 5) FROM fx_company UNION ALL SELECT cast(cik AS varchar) FROM fx_company
   UNION ALL SELECT 'cik' || lpad(cast(cik AS varchar), 10, '0') FROM fx_company UNION ALL SELECT ticker || '-A' FROM fx_company WHERE length(ticker) = 5
   UNION ALL SELECT 'nope' || name FROM fx_company) t),
c AS (SELECT q, regexp_replace(upper(trim(q)), '^CIK0*([^0].*)$', '\\1') AS k FROM r),
d AS (SELECT *, regexp_replace(k, '[-./][AB]$', '') AS base FROM c),
e AS (SELECT d.*, (SELECT min(lpad(cast(cik AS varchar), 10, '0')) FROM fx_company WHERE ticker = k) AS exact,
   CASE WHEN base <> k THEN (SELECT min(lpad(cast(cik AS varchar), 10, '0')) FROM fx_company WHERE ticker = base) END AS classed,
   (SELECT arg_min(lpad(cast(cik AS varchar), 10, '0'), ticker) FROM fx_company WHERE starts_with(ticker, k) AND length(ticker) - length(k) BETWEEN 1 AND 2) AS longer FROM d)
SELECT q AS query, CASE WHEN regexp_matches(k, '^[0-9]+$') THEN lpad(k, 10, '0') ELSE coalesce(exact, classed, longer) END AS cik,
 CASE WHEN regexp_matches(k, '^[0-9]+$') THEN 'number' WHEN exact IS NOT NULL THEN 'ticker' WHEN classed IS NOT NULL THEN 'share_class' WHEN longer IS NOT NULL THEN 'prefix' END AS matched FROM e
""")
def resolve_entity(i):
    c = i.fx_company
    asked = c.select(F.explode(F.array(
        "ticker", F.expr("left(ticker, 5)"), F.col("cik").cast("string"), F.concat(F.lit("cik"), lb.pad_cik("cik")),
        F.when(F.length("ticker") == 5, F.concat("ticker", F.lit("-A"))), F.concat(F.lit("nope"), "name"),
    )).alias("query")).where("query IS NOT NULL")
    return en.resolve_entity(asked, c)


@query("resolve_alias", """
WITH a AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS alias FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_partkey % 3 = 0),
m AS (SELECT p_partkey, alias, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN alias = lower(t) THEN 1 ELSE 0 END DESC, length(alias) DESC, alias DESC) AS rn
  FROM (SELECT p_partkey, 'Shares of ' || p_name || ' rose' AS t FROM part) p JOIN a ON regexp_matches(lower(t), '\\b' || alias || '\\b') AND length(alias) >= 3)
SELECT p_partkey, upper(alias) AS ticker, alias FROM m WHERE rn = 1
""")
def resolve_alias(i):
    p = i.part
    first = p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("alias"))
    aliases = first.union(p.where("p_partkey % 3 = 0").select("p_name")).distinct().withColumn("ticker", F.upper("alias"))
    texts = p.select("p_partkey", F.concat(F.lit("Shares of "), "p_name", F.lit(" rose")).alias("text"))
    return en.resolve_alias(texts, aliases, "p_partkey", "text")


@query("search_companies", """
WITH s AS (SELECT *, CASE WHEN upper(ticker) = 'T00' THEN 100.0 WHEN starts_with(upper(ticker), 'T00') THEN 60.0 - length(ticker) WHEN starts_with(upper(name), 'T00') THEN 40.0
  WHEN contains(upper(name), 'T00') THEN 20.0 END::double AS score FROM fx_company)
SELECT cik, ticker, name, exchange, sector, score FROM s WHERE score IS NOT NULL AND sector = 'ASIA' AND lower(exchange) = 'nyse' ORDER BY score DESC, ticker LIMIT 10
""")
def search_companies(i):
    return en.search_companies(i.fx_company, "t00", 10, sector="ASIA", exchange="NYSE").select(
        "cik", "ticker", "name", "exchange", "sector", "score")


@query("search_companies_enriched", """
WITH e AS (SELECT c.*, p.price * c.shares AS market_cap, (SELECT min(filed) FROM fx_filings f WHERE f.cik = c.cik) AS first_filed FROM fx_company c LEFT JOIN fx_prices p ON c.cik = p.cik)
SELECT cik, ticker, market_cap, first_filed, 1.0::double AS score FROM e WHERE market_cap >= 80000 AND contains(lower(country), 'nation_1') AND first_filed > date '1994-01-01' ORDER BY ticker LIMIT 20
""")
def search_companies_enriched(i):
    full = en.enrich_profile(i.fx_company, i.fx_filings, i.fx_prices)
    out = en.search_companies(full, "", 20, market_cap_min=80000, country="NATION_1", first_filed_after="1994-01-01")
    return out.select("cik", "ticker", "market_cap", "first_filed", "score")


INDEX_NAMES = "['spx', ' S&P500 ', '^ftse', 'Dow', 'nasdaq', 'Russell2000', 'none such', 'vix']"


@query("symbol_forms", f"""
WITH t AS (SELECT cik, ticker, CASE cik % 3 WHEN 0 THEN replace(ticker, '-', '.') WHEN 1 THEN lower(replace(ticker, '-', '/')) ELSE ticker END AS given, list_element({INDEX_NAMES}, (cik % 8 + 1)::int) AS name FROM fx_company),
i AS (SELECT *, upper(trim(name)) AS key FROM t)
SELECT cik, regexp_replace(upper(given), '[./]', '-', 'g') AS dashed, CASE WHEN key LIKE '^%' THEN key WHEN key IN ('SPX', 'S&P500') THEN '^GSPC' WHEN key = 'DOW' THEN '^DJI' WHEN key = 'NASDAQ' THEN '^IXIC' WHEN key = 'RUSSELL2000' THEN '^RUT' WHEN key = 'VIX' THEN '^VIX' END AS index_symbol FROM i
""")
def symbol_forms(i):
    given = F.when(F.col("cik") % 3 == 0, F.replace("ticker", F.lit("-"), F.lit("."))).when(
        F.col("cik") % 3 == 1, F.lower(F.replace("ticker", F.lit("-"), F.lit("/")))).otherwise(F.col("ticker"))
    name = F.expr(f"element_at(array({INDEX_NAMES[1:-1]}), cast(cik % 8 + 1 AS int))")
    return i.fx_company.select("cik", lb.dash_class(given).alias("dashed"), lb.index_symbol(name).alias("index_symbol"))


@query("tiered_search", """
WITH t AS (SELECT *, CASE WHEN upper(ticker) = 'T0020-A' THEN 0 WHEN starts_with(ticker, 'T0020-A') THEN 1 WHEN contains(upper(name), 'T0020-A') THEN 2 END AS tier FROM fx_company)
SELECT cik, ticker, tier FROM t WHERE tier IS NOT NULL
UNION ALL SELECT cik, ticker, 1 FROM (SELECT * FROM fx_company WHERE starts_with(ticker, 'T001') ORDER BY ticker LIMIT 10) u
""")
def tiered_search(i):
    c = i.fx_company
    return en.tiered_search(c, "t0020-a", 10).select("cik", "ticker", "tier").union(
        en.tiered_search(c, "t001", 10).select("cik", "ticker", "tier"))


@query("enrich_profile", """
SELECT c.cik, c.ticker, min(f.filed) AS first_filed, max(p.price) AS price, max(p.price * c.shares) AS market_cap
FROM fx_company c LEFT JOIN fx_filings f ON c.cik = f.cik LEFT JOIN fx_prices p ON c.cik = p.cik GROUP BY c.cik, c.ticker
""")
def enrich_profile(i):
    return en.enrich_profile(i.fx_company, i.fx_filings, i.fx_prices).select("cik", "ticker", "first_filed", "price", "market_cap")


# Annual reports around a document, with the executive named in one of four ways or not at all.
SURNAMES = "['Smith', 'Jones', 'Young', 'Stone', 'Ward', 'Baker', 'Fox']"
EXECUTIVE = """CASE cik % 5 WHEN 0 THEN 'Chief Executive Officer, Ann B. ' || who WHEN 1 THEN 'Carl ' || who || ', Chief Executive Officer'
  WHEN 2 THEN 'the CEO - Dora ' || who WHEN 3 THEN 'Eve J ' || who || ' — CEO' ELSE 'the officers' END"""
REPORTS = f"""SELECT cik, form, filed, accn, coalesce(text, '') || chr(10) || {EXECUTIVE} || chr(10) || 'and others.' AS text
FROM (SELECT f.*, d.text, {{pick}} AS who FROM fx_filings f LEFT JOIN documents d ON d.doc_id = (f.cik * 8 + year(f.filed)) % 1000 WHERE f.form IN ('10-K', '10-Q')) x"""


@query("profile_executives", f"""
WITH r AS ({REPORTS.format(pick=f"list_element({SURNAMES}, (year(f.filed) % 7 + 1)::int)")}),
n AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filed DESC, accn DESC) AS rn FROM r WHERE form = '10-K'),
e AS (SELECT cik, filed, coalesce({", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in tx.CHIEF_PATTERNS)}) AS ceo FROM n WHERE rn = 1)
SELECT c.cik, trim(ceo) AS ceo, CASE WHEN ceo IS NOT NULL THEN '10-K filed ' || cast(filed AS varchar) END AS ceo_source FROM fx_company c LEFT JOIN e ON c.cik = e.cik
""")
def profile_executives(i):
    i.fx_filings.createOrReplaceTempView("fx_filings")
    i.documents.createOrReplaceTempView("documents")
    pick = f"element_at(array({SURNAMES[1:-1]}), cast(year(f.filed) % 7 + 1 AS int))"
    return en.enrich_profile(i.fx_company.select("cik"), texts=i.spark.sql(REPORTS.format(pick=pick))).select("cik", "ceo", "ceo_source")


@query("fill_quote_gaps", """
SELECT c.cik, coalesce(CASE WHEN c.cik % 2 = 0 THEN p.price END, c.cik::double) AS price, coalesce(p.price * 2, c.shares) AS high FROM fx_company c LEFT JOIN fx_prices p ON c.cik = p.cik
""")
def fill_quote_gaps(i):
    q = i.fx_company.select("cik").join(i.fx_prices, "cik", "left").select(
        "cik", F.when(F.col("cik") % 2 == 0, F.col("price")).alias("price"), (F.col("price") * 2).alias("high"))
    ctx = i.fx_company.select("cik", F.col("cik").cast("double").alias("price"), F.col("shares").alias("high"))
    return en.fill_quote(q, ctx, ["price", "high"])


@query("index_members", "SELECT cik, ticker FROM fx_company WHERE sic % 2 = 0")
def index_members(i):
    members = i.fx_company.where("sic % 2 = 0").select(lb.dot_class("ticker").alias("ticker"))
    return en.index_members(i.fx_company, members).select("cik", "ticker")


@query("first_company_per_country", """
SELECT country, cik, ticker FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY ticker) AS rn FROM fx_company) t WHERE rn = 1
""")
def first_company_per_country(i):
    return en.first_wins(i.fx_company, ["country"], [F.col("ticker")]).select("country", "cik", "ticker")


@query("screening_universe", f"""
WITH {NEWEST}, r AS (SELECT cik, revenue FROM n WHERE cik NOT IN (SELECT cik FROM fx_company WHERE fund) ORDER BY revenue DESC, cik LIMIT 25)
SELECT cik, 'curated' AS origin FROM fx_company WHERE fund UNION ALL SELECT cik, 'ranked' FROM r
""")
def screening_universe(i):
    curated = i.fx_company.where("fund").select("cik")
    return en.universe(curated, _newest(i).select("cik", "revenue"), 25, [F.col("revenue").desc(), F.col("cik")])


@query("filing_work_list", """
SELECT cik, accn, form FROM fx_filings f WHERE NOT EXISTS (SELECT 1 FROM fx_filings g WHERE g.accn = f.accn AND g.cik = f.cik AND g.filed >= date '2001-01-01' AND g.filed <= date '2001-12-31')
""")
def filing_work_list(i):
    stored = i.fx_filings.where("filed <= date '2001-12-31'").withColumnRenamed("filed", "stored_on")
    return en.work_list(i.fx_filings, stored, ["cik", "accn"], 364, "2001-12-31").select("cik", "accn", "form")


@query("identifiers", """
SELECT cik, lpad(cast(cik AS varchar), 10, '0') AS padded, replace(ticker, '-', '.') AS dotted, regexp_replace(ticker, '[-./][AB]$', '') AS base,
  left(accn, 10) || '-' || substr(replace(accn, '-', ''), 11, 2) || '-' || right(accn, 6) AS accession
FROM (SELECT c.cik, ticker, accn FROM fx_company c JOIN fx_filings f ON c.cik = f.cik WHERE form = '10-K') t
""")
def identifiers(i):
    df = i.fx_company.select("cik", "ticker").join(i.fx_filings.where("form = '10-K'").select("cik", "accn"), "cik")
    bare = F.regexp_replace("accn", "-", "")
    return df.select("cik", lb.pad_cik("cik").alias("padded"), lb.dot_class("ticker").alias("dotted"),
                     lb.strip_class("ticker").alias("base"), lb.dashed_accession(bare).alias("accession"))


@query("filing_links", """
SELECT cik, accn, 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accn, '-', '') || '/' || accn || '-index.htm' AS filing_url,
 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accn, '-', '') || '/' AS folder_url,
 'https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK=' || lpad(cast(cik AS varchar), 10, '0') AS company_url FROM fx_filings
""")
def filing_links(i):
    return i.fx_filings.select("cik", "accn", *[c.alias(n) for n, c in lb.filing_links("cik", "accn").items()])


@query("sector_names", """
SELECT sector, CASE lower(sector) WHEN 'technology' THEN 'Technology' WHEN 'healthcare' THEN 'Health Care' WHEN 'basic materials' THEN 'Materials' END AS canonical, count(*) AS n
FROM (SELECT CASE cik % 4 WHEN 0 THEN 'TECHNOLOGY' WHEN 1 THEN 'Healthcare' WHEN 2 THEN 'basic materials' ELSE sector END AS sector FROM fx_company) t GROUP BY 1, 2
""")
def sector_names(i):
    s = F.when(F.col("cik") % 4 == 0, "TECHNOLOGY").when(F.col("cik") % 4 == 1, "Healthcare").when(
        F.col("cik") % 4 == 2, "basic materials").otherwise(F.col("sector"))
    df = i.fx_company.select(s.alias("sector"))
    return df.groupBy("sector", lb.normalize_sector("sector").alias("canonical")).agg(F.count("*").alias("n"))


@query("screen_metrics", f"""
WITH {NEWEST} SELECT cik, revenue, net_income / revenue AS net_margin, current_assets / nullif(current_liabilities, 0) AS current_ratio FROM n
WHERE revenue >= 1000000 AND net_income / revenue > 0.2 AND current_assets / nullif(current_liabilities, 0) BETWEEN 1 AND 5 ORDER BY revenue DESC, cik LIMIT 30
""")
def screen_metrics(i):
    df = rt.with_ratios(_newest(i))
    return sc.screen(df, [
        {"metric": "revenue", "operator": ">=", "value": 1000000}, {"metric": "net_margin", "operator": ">", "value": 0.2},
        {"metric": "current_ratio", "operator": "between", "value": 1, "value_max": 5},
    ], 30).select("cik", "revenue", "net_margin", "current_ratio")


@query("screen_ascending", f"""
WITH {NEWEST} SELECT cik, debt FROM (SELECT cik, long_term_debt / total_assets AS debt FROM n) t WHERE debt < 0.5 AND abs(debt - 0.15) < 0.001 ORDER BY debt, cik LIMIT 15
""")
def screen_ascending(i):
    df = _newest(i).withColumn("debt", F.col("long_term_debt") / F.col("total_assets"))
    return sc.screen(df, [{"metric": "debt", "operator": "<", "value": 0.5}, {"metric": "debt", "operator": "==", "value": 0.15}], 15).select("cik", "debt")


RANGE_ROW = "x AS (SELECT n.cik, c.sector, revenue, net_income, gross_profit / revenue AS gross_margin, net_income / revenue AS net_margin, eps_diluted AS eps, long_term_debt / nullif(stockholders_equity, 0) AS de_ratio FROM n JOIN fx_company c ON n.cik = c.cik)"


@query("screen_ranges", f"""
WITH {NEWEST}, {RANGE_ROW} SELECT * FROM x WHERE contains(lower(sector), 'a') AND gross_margin >= 0.3 AND net_margin <= 0.5 AND de_ratio <= 2 AND eps >= 1 AND net_income >= 1000 AND revenue >= 10 ORDER BY revenue DESC, cik LIMIT 50
""")
def screen_ranges(i):
    df = _newest(i).join(i.fx_company.select("cik", "sector"), "cik").select(
        "cik", "sector", "revenue", "net_income", (F.col("gross_profit") / F.col("revenue")).alias("gross_margin"),
        (F.col("net_income") / F.col("revenue")).alias("net_margin"), F.col("eps_diluted").alias("eps"),
        F.try_divide("long_term_debt", "stockholders_equity").alias("de_ratio"))
    return sc.screen_ranges(df, {"sector": " A ", "gross_margin_min": 0.3, "net_margin_max": 0.5, "de_ratio_max": 2,
                                 "eps_min": 1, "net_income_min": 1000, "revenue_min": 10}, 50)


COMPOSED = f"""{NEWEST}, prev AS (SELECT * FROM (SELECT cik, revenue AS prior_revenue, row_number() OVER (PARTITION BY cik ORDER BY fy DESC) AS rn FROM fx_wide) x WHERE rn = 2),
z AS (SELECT n.cik, c.sector, free_cash_flow AS fcf, (revenue - prior_revenue) / abs(prior_revenue) AS rev_growth, ebitda, coalesce(long_term_debt, 0) + coalesce(short_term_debt, 0) - coalesce(cash_and_equivalents, 0) AS net_debt,
  net_income, price, c.shares, price * c.shares AS market_cap FROM n JOIN fx_company c ON n.cik = c.cik LEFT JOIN prev p ON p.cik = n.cik LEFT JOIN fx_prices q ON q.cik = n.cik)"""


def _composed(i):
    top = rk.top_per_group(i.fx_wide, ["cik"], [F.col("fy").desc()], 2)
    pick = lambda n, c: F.max(F.when(F.col("rn") == n, F.col(c)))
    w = top.groupBy("cik").agg(*[pick(1, c).alias(c) for c in (
        "free_cash_flow", "revenue", "ebitda", "net_income", "long_term_debt", "short_term_debt", "cash_and_equivalents")],
        pick(2, "revenue").alias("prior_revenue"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return w.join(i.fx_company.select("cik", "sector", "shares"), "cik").join(i.fx_prices, "cik", "left").select(
        "cik", "sector", F.col("free_cash_flow").alias("fcf"),
        ((F.col("revenue") - F.col("prior_revenue")) / F.abs("prior_revenue")).alias("rev_growth"), "ebitda",
        (zero("long_term_debt") + zero("short_term_debt") - zero("cash_and_equivalents")).alias("net_debt"),
        "net_income", "price", "shares")


@query("screen_composed", f"""
WITH {COMPOSED} SELECT cik, market_cap, market_cap / net_income AS pe FROM z
WHERE fcf > 0 AND rev_growth >= -0.5 AND ebitda > 0 AND net_debt / ebitda <= 4 AND market_cap >= 70000 AND market_cap <= 900000 AND net_income > 0 AND market_cap / net_income <= 25
""")
def screen_composed(i):
    out = sc.screen_composed(_composed(i), {
        "fcf_positive": True, "rev_growth_min": -0.5, "net_debt_ebitda_max": 4, "market_cap_min": 70000,
        "market_cap_max": 900000, "pe_max": 25})
    return out.select("cik", "market_cap", "pe")


@query("screen_events", f"""
WITH {COMPOSED}, b AS (SELECT cik, count(*) AS insider_buys FROM fx_insider WHERE code = 'P' AND txn_date >= (SELECT max(cast(ts AS date)) FROM events) - 30 GROUP BY cik)
SELECT z.cik, insider_buys FROM z JOIN b ON z.cik = b.cik WHERE fcf > 0 AND z.cik IN (SELECT cik FROM fx_filings WHERE form LIKE '8-K%' AND filed >= (SELECT max(filed) FROM fx_filings WHERE form LIKE '8-K%') - 7)
""")
def screen_events(i):
    # Two single values, scalar subqueries of the same plan: each source has its own newest day.
    last_filing = i.fx_filings.where("form LIKE '8-K%'").agg(F.max("filed")).scalar()
    last_trade = i.fx_insider.agg(F.max("txn_date")).scalar()
    filings = i.fx_filings.withColumn("as_of", last_filing)
    insiders = i.fx_insider.withColumn("transaction_type", F.when(F.col("code") == "P", "Purchase").otherwise("Other"))
    insiders = insiders.withColumn("as_of", last_trade)
    out = sc.screen_composed(_composed(i), {"fcf_positive": True, "filed_8k_last_7d": True, "insider_buying_last_30d": True},
                             filings=filings, transactions=insiders, as_of=F.col("as_of"))
    return out.select("cik", "insider_buys")


@query("recent_event_companies", """
SELECT DISTINCT cik FROM fx_filings WHERE form LIKE '8-K%' AND filed >= date '2001-06-01' - 7
""")
def recent_event_companies(i):
    return sc.filed_recently(i.fx_filings, "8-K", F.lit("2001-06-01").cast("date"), 7)


@query("screen_coverage", f"WITH {NEWEST} SELECT count(DISTINCT cik) AS universe_size, count(DISTINCT CASE WHEN revenue > 2000000 THEN cik END) AS matches FROM n")
def screen_coverage(i):
    n = _newest(i)
    return sc.screen_coverage(n, n.where("revenue > 2000000"))


@query("company_coverage", "SELECT count(DISTINCT cik) AS covered, count(DISTINCT cik) / 150.0::double * 100 AS coverage_pct FROM fx_wide")
def company_coverage(i):
    return en.coverage(i.fx_wide, 150)


@query("top_by_revenue", f"WITH {NEWEST} SELECT cik, gross_profit FROM n ORDER BY gross_profit DESC NULLS LAST, cik LIMIT 80")
def top_by_revenue(i):
    return _newest(i).orderBy(F.col("gross_profit").desc_nulls_last(), "cik").limit(80).select("cik", "gross_profit")


@query("directory_page", """
SELECT ticker, cik, rank, total_pages FROM (SELECT ticker, cik, row_number() OVER (ORDER BY ticker) AS rank, cast(ceil(count(*) OVER () / 7.0) AS bigint) AS total_pages FROM fx_company) t WHERE rank BETWEEN 8 AND 14
""")
def directory_page(i):
    return rk.page(i.fx_company.select("ticker", "cik"), [F.col("ticker")], 2, 7)


@query("filings_between", """
SELECT cik, accn, form, filed FROM fx_filings WHERE form IN ('10-K', '10-K/A', '20-F', '20-F/A') AND filed BETWEEN date '1998-01-01' AND date '1999-06-30'
""")
def filings_between(i):
    return sc.filings_between(i.fx_filings, "1998-01-01", "1999-06-30", "10-k").select("cik", "accn", "form", "filed")


@query("form_aliases", """
SELECT 'DEF 14A' AS alias, form, count(*) AS n FROM fx_filings WHERE form IN ('DEF 14A', 'DEFA14A') GROUP BY form
UNION ALL SELECT '13D/G', form, count(*) FROM fx_filings WHERE form IN ('SC 13D', 'SC 13D/A', 'SC 13G', 'SC 13G/A') GROUP BY form
UNION ALL SELECT '8-K', form, count(*) FROM fx_filings WHERE form IN ('8-K', '8-K/A') GROUP BY form
""")
def form_aliases(i):
    wanted = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(f).alias("form")) for a in ("DEF 14A", "13D/G", "8-K") for f in lb.FORM_ALIASES[a]])
    hit = F.filter(wanted, lambda x: x["form"] == F.col("form"))
    df = i.fx_filings.select("form", F.explode(hit).alias("x")).select("form", "x.alias")
    return df.groupBy("alias", "form").agg(F.count("*").alias("n"))


@query("filing_for_year", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY CASE WHEN year(report_date) = 1999 THEN 0 WHEN year(filed) IN (1999, 2000) THEN 1 ELSE 2 END,
   report_date DESC NULLS LAST, filed DESC, accn) AS rn FROM fx_filings WHERE form = '10-K')
SELECT cik, accn, filed, report_date FROM r WHERE rn = 1
""")
def filing_for_year(i):
    return sc.filing_for_year(i.fx_filings, 1999).select("cik", "accn", "filed", "report_date")


@query("capped_filings", """
SELECT cik, form, accn FROM (SELECT *, row_number() OVER (PARTITION BY cik, form ORDER BY filed DESC NULLS LAST, accn) AS rn FROM fx_filings) t WHERE rn <= CASE form WHEN '10-K' THEN 3 WHEN '10-Q' THEN 5 ELSE 8 END
""")
def capped_filings(i):
    return sc.capped_filings(i.fx_filings, {"10-K": 3, "10-Q": 5}, 8).select("cik", "form", "accn")


@query("form_flags", """
SELECT cik, bool_or(form IN ('10-K', '20-F', '40-F')) AS has_annual, max(CASE WHEN form IN ('10-K', '20-F', '40-F') THEN filed END) AS last_annual,
 bool_or(form IN ('10-Q', '6-K')) AS has_quarterly, max(CASE WHEN form IN ('10-Q', '6-K') THEN filed END) AS last_quarterly, bool_or(form = '8-K') AS has_current, max(CASE WHEN form = '8-K' THEN filed END) AS last_current
FROM fx_filings GROUP BY cik
""")
def form_flags(i):
    return sc.form_flags(i.fx_filings)


@query("first_filed", "SELECT cik, min(filed) AS first_filed FROM fx_filings GROUP BY cik")
def first_filed(i):
    return en.enrich_profile(i.fx_filings.select("cik").distinct(), i.fx_filings).select("cik", "first_filed")


@query("weekday_calendar", """
WITH d AS (SELECT DISTINCT filed AS as_of FROM fx_filings WHERE form = '8-K'),
x AS (SELECT as_of, cast(as_of - k::int AS date) AS day FROM d, (SELECT unnest(range(0, 11)) AS k) g),
y AS (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY day DESC) AS rn FROM x WHERE dayofweek(day) NOT IN (0, 6)) SELECT as_of, day FROM y WHERE rn <= 5
""")
def weekday_calendar(i):
    days = i.fx_filings.where("form = '8-K'").select(F.col("filed").alias("as_of")).distinct()
    return sc.weekday_calendar(days, 5)


@query("metric_ranks", """
SELECT ticker, metric, value, row_number() OVER w AS rank, count(*) OVER (PARTITION BY metric) AS group_size,
 100.0::double - (row_number() OVER w - 1) * 100.0::double / count(*) OVER (PARTITION BY metric) AS percentile, row_number() OVER w = 1 AS best
FROM (SELECT ticker, metric, value FROM fx_long l JOIN fx_company c ON l.cik = c.cik WHERE fy = 2000) t WINDOW w AS (PARTITION BY metric ORDER BY value DESC NULLS LAST, ticker)
""")
def metric_ranks(i):
    df = i.fx_long.where("fy = 2000").join(i.fx_company.select("cik", "ticker"), "cik").select("ticker", "metric", "value")
    return rk.metric_ranks(df)


PEER_LISTS = """cur AS (SELECT a.ticker, b.ticker AS peer, cast(b.cik AS int) AS position FROM fx_company a JOIN fx_company b ON b.cik = a.cik + 1 OR b.cik = a.cik + 2 WHERE a.cik % 4 = 0),
cus AS (SELECT a.ticker, b.ticker AS peer, cast(b.cik AS int) AS position FROM fx_company a JOIN fx_company b ON b.cik = a.cik + 3 WHERE a.cik % 6 = 0),
uni AS (SELECT key, ticker AS peer, row_number() OVER (ORDER BY key, cik) AS place FROM (SELECT replace(lower(country), ' ', '_') AS key, ticker, cik FROM fx_company) t WHERE key NOT IN ('united_states', 'saudi_arabia', 'china')),
ind AS (SELECT ticker, replace(lower(CASE WHEN cik % 8 = 1 THEN 'Kingdom Of Saudi-Iran' ELSE country END), '-', '_') AS raw FROM fx_company),
"""

PEERS = f"""
WITH {PEER_LISTS} own AS (SELECT ticker, replace(raw, ' ', '_') AS key FROM ind),
grp AS (SELECT o.ticker, u.peer, min(u.place) AS place, 'same group' AS reason FROM own o JOIN uni u ON u.key = o.key GROUP BY o.ticker, u.peer),
ovl AS (SELECT o.ticker, u.peer, min(u.place) AS place, 'shared word' AS reason FROM own o JOIN uni u ON len(list_intersect(string_split(o.key, '_'), string_split(u.key, '_'))) > 0
  WHERE o.key NOT IN (SELECT key FROM uni) GROUP BY o.ticker, u.peer),
fal AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY place) AS position FROM (SELECT * FROM grp UNION ALL SELECT * FROM ovl) t WHERE ticker <> peer),
p AS (SELECT ticker, peer, position, 1.0::double AS relevance, 'custom' AS reason FROM cus
 UNION ALL SELECT ticker, peer, position, 0.95::double, 'curated' FROM cur WHERE ticker NOT IN (SELECT ticker FROM cus)
 UNION ALL SELECT ticker, peer, position, 0.70::double, reason FROM fal WHERE position <= 6 AND ticker NOT IN (SELECT ticker FROM cus) AND ticker NOT IN (SELECT ticker FROM cur)),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY relevance DESC, position, peer) AS n FROM p WHERE relevance >= LEAST)
SELECT ticker, peer, relevance, reason, n FROM r WHERE n <= 3
"""


def _peers(i, min_relevance: float):
    c = i.fx_company
    follow = lambda cond, *steps: c.select("ticker", "cik").where(cond).withColumn("k", F.explode(F.array(*[F.col("cik") + s for s in steps]))).join(
        c.select(F.col("cik").alias("k"), F.col("ticker").alias("peer")), "k").select("ticker", "peer", F.col("k").cast("int").alias("position"))
    # Peer groups by country, three countries left out: companies there fall back to groups that share a word.
    groups = c.select(en.group_key(F.col("country")).alias("key"), F.col("ticker").alias("peer"), "cik")
    groups = groups.where(~F.col("key").isin("united_states", "saudi_arabia", "china"))
    groups = groups.select("key", "peer", F.struct("key", "cik").alias("place"))
    company = c.select("ticker", F.when(F.col("cik") % 8 == 1, "Kingdom Of Saudi-Iran").otherwise(F.col("country")).alias("industry"))
    return en.find_peers(c, company, curated=follow("cik % 4 = 0", 1, 2), custom=follow("cik % 6 = 0", 3), universe=groups,
                         max_peers=3, min_relevance=min_relevance)


@query("find_peers", PEERS.replace("LEAST", "0.0"))
def find_peers(i):
    return _peers(i, 0.0)


@query("find_peers_relevant", PEERS.replace("LEAST", "0.9"))
def find_peers_relevant(i):
    return _peers(i, 0.9)


@query("find_comps", f"""
WITH {NEWEST}, b AS (SELECT c.sector, c.ticker, CASE WHEN c.cik % 12 = 0 THEN NULL ELSE revenue END AS revenue FROM n JOIN fx_company c ON n.cik = c.cik),
p AS (SELECT a.sector, a.ticker, x.ticker AS peer, CASE WHEN x.revenue IS NULL THEN 1000.0 ELSE greatest(x.revenue / a.revenue, a.revenue / x.revenue) END AS distance,
  x.revenue IS NULL OR x.revenue BETWEEN a.revenue * 0.99 AND a.revenue * 1.01 AS scored FROM b a JOIN b x ON a.sector = x.sector AND a.ticker <> x.ticker WHERE a.revenue > 0),
q AS (SELECT *, count(CASE WHEN scored THEN 1 END) OVER (PARTITION BY ticker) AS k FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY ticker) AS pos FROM b),
s AS (SELECT sector, ticker, peer, distance FROM q WHERE scored OR k < 3
  UNION ALL SELECT a.sector, a.ticker, x.ticker, (x.pos - a.pos)::double FROM o a JOIN o x ON a.sector = x.sector AND x.pos - a.pos BETWEEN -2 AND 3 AND x.pos <> a.pos WHERE a.revenue IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY distance, peer) AS n FROM s) SELECT sector, ticker, peer, distance, n FROM r WHERE n <= 5
""")
def find_comps(i):
    df = _newest(i).select("cik", "revenue").join(i.fx_company.select("cik", "sector", "ticker"), "cik")
    df = df.withColumn("revenue", F.when(F.col("cik") % 12 != 0, F.col("revenue")))
    return en.find_comps(df, low=0.99, high=1.01)


@query("fund_profiles", """
WITH d AS (SELECT ticker, CASE WHEN cik % 3 = 0 THEN 'ETF' ELSE 'CS' END AS type, CASE WHEN cik % 6 = 0 THEN name END AS name, CASE WHEN cik % 5 = 0 THEN shares * 7 END AS market_cap, shares, date '2000-01-01' AS list_date, cik FROM fx_company),
s AS (SELECT ticker, 'Fund ' || ticker AS seed_name, CASE WHEN cik % 2 = 0 THEN 'Commodity' ELSE 'Fixed Income' END AS asset_class, CASE WHEN cik % 4 = 0 THEN date '1999-05-05' END AS inception_date FROM fx_company WHERE fund),
p AS (SELECT c.ticker, price FROM fx_prices f JOIN fx_company c ON c.cik = f.cik),
j AS (SELECT d.*, s.seed_name, s.asset_class, s.inception_date, p.price FROM d LEFT JOIN s ON d.ticker = s.ticker LEFT JOIN p ON p.ticker = d.ticker WHERE s.ticker IS NOT NULL OR d.type = 'ETF')
SELECT ticker, coalesce(name, seed_name, ticker) AS name, coalesce(market_cap, shares * price) AS aum, CASE WHEN market_cap IS NOT NULL THEN 'market_cap' WHEN shares * price IS NOT NULL THEN 'shares_x_price' END AS aum_source,
 coalesce(asset_class, 'Equity') AS asset_class, coalesce(inception_date, list_date) AS inception_date,
 CASE asset_class WHEN 'Commodity' THEN 'GLD,SLV' WHEN 'Fixed Income' THEN 'BND,AGG,TLT,LQD,HYG' ELSE 'VOO,IVV,VTI,QQQ,DIA' END AS peers, CASE WHEN seed_name IS NOT NULL THEN 'seed+provider' ELSE 'provider' END AS profile_source FROM j
""")
def fund_profiles(i):
    c = i.fx_company
    day = lambda t: F.lit(t).cast("date")
    details = c.select("ticker", F.when(F.col("cik") % 3 == 0, "ETF").otherwise("CS").alias("type"), F.when(F.col("cik") % 6 == 0, F.col("name")).alias("name"),
                       F.when(F.col("cik") % 5 == 0, F.col("shares") * 7).alias("market_cap"), "shares", day("2000-01-01").alias("list_date"))
    seeds = c.where("fund").select("ticker", F.concat(F.lit("Fund "), "ticker").alias("seed_name"),
                                   F.when(F.col("cik") % 2 == 0, "Commodity").otherwise("Fixed Income").alias("asset_class"),
                                   F.when(F.col("cik") % 4 == 0, day("1999-05-05")).alias("inception_date"))
    prices = i.fx_prices.join(c.select("cik", "ticker"), "cik")
    return en.fund_profiles(details, seeds, prices).withColumn("peers", F.array_join("peers", ","))


OWN = "own AS (SELECT cik, end_date, metric, value FROM fx_long WHERE metric IN ('revenue', 'net_income', 'total_assets'))"


@query("cross_check", f"""
WITH {OWN}, e AS (SELECT DISTINCT cik, end_date FROM own), v AS (SELECT * FROM fx_vendor WHERE fy <> 1996),
a AS (SELECT e.cik, e.end_date, max(CASE WHEN abs(DAYS(e.end_date, v.end_date)) <= 14 THEN v.end_date END) AS a_end, max(v.end_date) AS t_end FROM e LEFT JOIN v ON e.cik = v.cik GROUP BY e.cik, e.end_date),
j AS (SELECT own.*, coalesce(a_end, t_end) AS v_end, a_end IS NOT NULL AS aligned FROM own JOIN a ON own.cik = a.cik AND own.end_date = a.end_date),
k AS (SELECT j.*, v.value AS vendor_value FROM j LEFT JOIN v ON v.cik = j.cik AND v.end_date = j.v_end AND v.metric = j.metric)
SELECT cik, end_date, metric, value, vendor_value, CASE WHEN vendor_value IS NULL THEN 0.0 WHEN vendor_value = 0 THEN CASE WHEN value = 0 THEN 0.0 ELSE 100.0 END ELSE abs(value - vendor_value) / abs(vendor_value) * 100 END AS diff_pct,
 CASE WHEN vendor_value IS NULL THEN false WHEN vendor_value = 0 THEN value = 0 ELSE abs(value - vendor_value) / abs(vendor_value) * 100 <= 5.0 END AS match,
 'annual_vs_annual_' || cast(v_end AS varchar) || CASE WHEN aligned THEN '' ELSE '_unaligned' END AS basis FROM k
""")
def cross_check(i):
    own = i.fx_long.where("metric IN ('revenue', 'net_income', 'total_assets')").select("cik", "end_date", "metric", "value")
    return cp.cross_check(own, i.fx_vendor.where("fy <> 1996"))


@query("cross_check_status", """
WITH own AS (SELECT cik, end_date, metric, value FROM fx_long WHERE metric IN ('revenue', 'net_income')), e AS (SELECT DISTINCT cik, end_date FROM own),
a AS (SELECT e.cik, e.end_date, max(v.end_date) AS v_end FROM e JOIN fx_vendor v ON e.cik = v.cik AND abs(DAYS(e.end_date, v.end_date)) <= 10 GROUP BY e.cik, e.end_date),
k AS (SELECT own.*, v.value AS vv FROM own LEFT JOIN a ON own.cik = a.cik AND own.end_date = a.end_date LEFT JOIN fx_vendor v ON v.cik = own.cik AND v.end_date = a.v_end AND v.metric = own.metric)
SELECT cik, end_date, count(CASE WHEN vv <> 0 THEN 1 END) AS checks, CASE WHEN count(CASE WHEN vv <> 0 THEN 1 END) = 0 THEN 'unavailable' WHEN bool_and(CASE WHEN vv <> 0 THEN abs(value - vv) / abs(vv) * 100 <= 2.0 END) THEN 'ok' ELSE 'mismatch' END AS status
FROM k GROUP BY cik, end_date
""")
def cross_check_status(i):
    return cp.cross_check_status(i.fx_long.select("cik", "end_date", "metric", "value"), i.fx_vendor)


DIFF = """d AS (SELECT coalesce(a.cik, b.cik) AS cik, coalesce(a.metric, b.metric) AS metric, a.value AS year1, b.value AS year2 FROM (SELECT * FROM fx_long WHERE fy = 1999 AND (metric <> 'ebitda' OR cik % 2 = 0)) a
   FULL OUTER JOIN (SELECT * FROM fx_long WHERE fy = 2000 AND (metric <> 'revenue' OR cik % 5 <> 0)) b ON a.cik = b.cik AND a.metric = b.metric),
e AS (SELECT *, (cast(coalesce(year2, 0) AS decimal(28,4)) - cast(coalesce(year1, 0) AS decimal(28,4)))::double AS change FROM d),
diff AS (SELECT *, CASE WHEN coalesce(year1, 0) <> 0 THEN change / abs(year1) * 100 WHEN coalesce(year2, 0) = 0 THEN 0.0 ELSE 999.9 END::double AS change_pct FROM e),
labelled AS (SELECT *, CASE WHEN abs(change_pct) > 20 THEN 'major' WHEN abs(change_pct) > 10 THEN 'moderate' ELSE 'minor' END AS significance FROM diff)"""


def _diff(i):
    kept = "(fy = 1999 AND (metric <> 'ebitda' OR cik % 2 = 0)) OR (fy = 2000 AND (metric <> 'revenue' OR cik % 5 <> 0))"
    return cp.diff_periods(i.fx_long.where(kept), 1999, 2000)


@query("diff_periods", f"WITH {DIFF} SELECT * FROM labelled")
def diff_periods(i):
    return _diff(i)


@query("diff_summary", f"""
WITH {DIFF} SELECT cik, coalesce('Major changes: ' || string_agg(CASE WHEN significance = 'major' THEN metric || ': ' || CASE WHEN change_pct >= 0 THEN '+' ELSE '' END || cast(cast(change_pct AS decimal(28,1)) AS varchar) || '%' END, ', ' ORDER BY metric),
  'No major changes; all metrics shifted < 20%') AS summary FROM labelled GROUP BY cik
""")
def diff_summary(i):
    return cp.diff_summary(_diff(i))


@query("diff_ratios", """
WITH r AS (SELECT cik, fy, 'net_margin' AS metric, net_income / revenue AS value FROM fx_wide UNION ALL SELECT cik, fy, 'debt', long_term_debt / total_assets FROM fx_wide WHERE long_term_debt IS NOT NULL),
j AS (SELECT a.cik, a.metric, a.value AS year1, b.value AS year2, (b.value - a.value) / abs(a.value) * 100 AS change_pct FROM r a JOIN r b ON a.cik = b.cik AND a.metric = b.metric WHERE a.fy = 1999 AND b.fy = 2000 AND a.value <> 0)
SELECT *, CASE WHEN abs(change_pct) > 30 THEN 'major' WHEN abs(change_pct) > 15 THEN 'moderate' ELSE 'minor' END AS significance FROM j
""")
def diff_ratios(i):
    r = i.fx_wide.select("cik", "fy", F.explode(F.array(
        F.struct(F.lit("net_margin").alias("metric"), (F.col("net_income") / F.col("revenue")).alias("value")),
        F.struct(F.lit("debt").alias("metric"), (F.col("long_term_debt") / F.col("total_assets")).alias("value")),
    )).alias("x")).select("cik", "fy", "x.*").where("value IS NOT NULL")
    return cp.diff_ratios(r, 1999, 2000)


@query("metric_key_union", "SELECT metric FROM fx_long WHERE fy = 1999 UNION SELECT metric FROM fx_vendor WHERE fy = 2000")
def metric_key_union(i):
    return cp.metric_keys(i.fx_long.where("fy = 1999"), i.fx_vendor.where("fy = 2000"))


@query("compare_companies", """
WITH l AS (SELECT c.ticker, metric, value, row_number() OVER (PARTITION BY c.ticker, metric ORDER BY end_date DESC) AS rn FROM fx_long JOIN fx_company c ON fx_long.cik = c.cik WHERE metric IN ('revenue', 'net_income', 'total_assets', 'gross_profit'))
SELECT metric, max(CASE WHEN ticker = 'T0001' THEN value END) AS "T0001", max(CASE WHEN ticker = 'T0002' THEN value END) AS "T0002", max(CASE WHEN ticker = 'T0005' THEN value END) AS "T0005" FROM l WHERE rn = 1 AND ticker IN ('T0001', 'T0002', 'T0005') GROUP BY metric
""")
def compare_companies(i):
    long = i.fx_long.join(i.fx_company.select("cik", "ticker"), "cik")
    return cp.compare_companies(long, sc.several(["t0001", "T0002", "T0005"], "ticker", range(2, 9)), ["revenue", "net_income", "total_assets", "gross_profit"])


@query("compare_failures", "SELECT ticker FROM fx_company WHERE cik NOT IN (SELECT cik FROM fx_long WHERE metric = 'gross_profit')")
def compare_failures(i):
    have = i.fx_long.where("metric = 'gross_profit'").join(i.fx_company.select("cik", "ticker"), "cik")
    return cp.compare_failures(have, i.fx_company.select("ticker"))


@query("chart_series", """
SELECT cik, metric, string_agg(cast(end_date AS varchar), ',' ORDER BY end_date) AS dates, count(*) AS points FROM (SELECT *, row_number() OVER (PARTITION BY cik, metric ORDER BY end_date DESC) AS rn FROM fx_long WHERE metric IN ('revenue', 'free_cash_flow')) t WHERE rn <= 5 GROUP BY cik, metric
""")
def chart_series(i):
    s = cp.chart_series(i.fx_long, ["revenue", "free_cash_flow"], 5)
    dates = F.transform("end_dates", lambda d: d.cast("string"))
    return s.select("cik", "metric", F.array_join(dates, ",").alias("dates"), F.size("values").cast("long").alias("points"))


@query("assemble_statements", """
SELECT cik, end_date, count(CASE WHEN metric IN ('revenue', 'cost_of_revenue', 'gross_profit', 'operating_income', 'net_income', 'eps_diluted') THEN 1 END) AS income_lines,
 count(CASE WHEN metric IN ('total_assets', 'total_liabilities', 'stockholders_equity', 'cash_and_equivalents') THEN 1 END) AS balance_lines,
 count(CASE WHEN metric IN ('operating_cash_flow', 'capital_expenditures', 'free_cash_flow') THEN 1 END) AS cashflow_lines,
 max(CASE WHEN metric = 'revenue' THEN value END) AS revenue, max(CASE WHEN metric = 'total_liabilities' THEN value END) AS total_liabilities, max(CASE WHEN metric = 'free_cash_flow' THEN value END) AS free_cash_flow
FROM fx_long GROUP BY cik, end_date
""")
def assemble_statements(i):
    return cp.assemble_statements(i.fx_long).select(
        "cik", "end_date", "income_lines", "balance_lines", "cashflow_lines", "revenue", "total_liabilities", "free_cash_flow")


def _two_years(i):
    keep = [m for m in i.fx_wide.columns if m not in ("fy", "end_date")]
    return i.fx_wide.where("fy = 2000").select(*keep), i.fx_wide.where("fy = 1999").select(*keep)


def _template_sql():
    have = set("revenue cost_of_revenue gross_profit operating_income net_income income_tax_expense income_before_tax interest_expense operating_expenses depreciation_amortization eps_diluted shares_outstanding".split())
    parts = []
    for t, n, label, m in cp.template_lines():
        label = label.replace("'", "''")
        if m == "":
            parts.append(f"SELECT a.cik, '{t}' AS template, {n} AS line_no, '{label}' AS label, NULL::double AS value, NULL::double AS prior_value FROM a JOIN k ON a.cik = k.cik WHERE template = '{t}'")
        elif m in have:
            parts.append(f"SELECT a.cik, '{t}' AS template, {n} AS line_no, '{label}' AS label, a.{m} AS value, b.{m} AS prior_value FROM a JOIN k ON a.cik = k.cik LEFT JOIN b ON a.cik = b.cik WHERE template = '{t}' AND (a.{m} IS NOT NULL OR b.{m} IS NOT NULL)")
        if t == "standard" and m == "gross_profit":
            parts.append(f"SELECT a.cik, '{t}', {n + 1}, 'Gross Margin %', a.gross_profit / a.revenue * 100, b.gross_profit / b.revenue * 100 FROM a JOIN k ON a.cik = k.cik LEFT JOIN b ON a.cik = b.cik WHERE template = '{t}' AND a.gross_profit <> 0")
    return f"""WITH a AS (SELECT * FROM fx_wide WHERE fy = 2000), b AS (SELECT * FROM fx_wide WHERE fy = 1999),
k AS (SELECT cik, CASE WHEN industry IN ('bank', 'insurance', 'reit') THEN industry ELSE 'standard' END AS template FROM (SELECT cik, {INDUSTRY} AS industry FROM fx_company) c)
{' UNION ALL '.join(parts)}"""


@query("industry_statement", _template_sql())
def industry_statement(i):
    now, before = _two_years(i)
    return cp.industry_statement(now, before, i.fx_company.select("cik", lb.industry_class("sic").alias("industry")))


@query("export_rows", """
WITH a AS (SELECT * FROM fx_wide WHERE fy = 2000), b AS (SELECT * FROM fx_wide WHERE fy = 1999),
r AS (SELECT a.cik, 0 AS line_no, 'revenue' AS metric_name, a.revenue AS current_value, b.revenue AS prior_value FROM a LEFT JOIN b ON a.cik = b.cik
 UNION ALL SELECT a.cik, 1, 'gross_profit', a.gross_profit, b.gross_profit FROM a LEFT JOIN b ON a.cik = b.cik)
SELECT cik, line_no, metric_name, current_value, prior_value, cast((current_value - prior_value) / abs(prior_value) * 100 AS decimal(28,2))::double AS change_pct FROM r WHERE current_value IS NOT NULL OR prior_value IS NOT NULL
UNION ALL SELECT cik, 2, 'ratio_net_margin', net_income / revenue, NULL, NULL FROM a
""")
def export_rows(i):
    now, before = _two_years(i)
    return cp.export_rows(rt.with_ratios(now), before, ["revenue", "gross_profit"], ["net_margin"])


@query("company_narrative", """
WITH w AS (SELECT x.*, c.name, lag(revenue) OVER (PARTITION BY x.cik ORDER BY fy) AS p FROM fx_wide x JOIN fx_company c ON x.cik = c.cik)
SELECT cik, fy, name || ' (fiscal ' || fy || ').' AS head, CASE WHEN p IS NULL THEN 'no prior' WHEN revenue > p THEN 'grew' WHEN revenue < p THEN 'fell' ELSE 'was flat' END AS trend,
 CASE WHEN current_liabilities = 0 THEN 'unknown' WHEN current_assets / current_liabilities >= 2 THEN 'strong' WHEN current_assets / current_liabilities >= 1 THEN 'adequate' ELSE 'tight' END AS liquidity FROM w
""")
def company_narrative(i):
    from pyspark.sql import Window
    prior = F.lag("revenue").over(Window.partitionBy("cik").orderBy("fy"))
    df = rt.with_ratios(i.fx_wide).withColumn("revenue_growth", (F.col("revenue") - prior) / F.abs(prior))
    df = df.join(i.fx_company.select("cik", "name"), "cik")
    df = df.withColumn("t", ck.narrative(df))
    trend = F.regexp_extract("t", "Revenue (grew|fell|was flat)", 1)
    health = F.regexp_extract("t", "Liquidity is ([a-z]+)[.]", 1)
    return df.select("cik", "fy", F.regexp_extract("t", "^(.*?[.])", 1).alias("head"),
                     F.when(trend == "", "no prior").otherwise(trend).alias("trend"),
                     F.when(health == "", "unknown").otherwise(health).alias("liquidity"))


@query("valued_comparison", f"""
WITH {VALUE_SQL} SELECT cik, fy, pe_ratio, market_cap FROM valued WHERE fy = 2000 AND pe_basis = 'eps'
""")
def valued_comparison(i):
    return rt.with_valuation(i.fx_wide.join(i.fx_prices, "cik", "left")).where("fy = 2000 AND pe_basis = 'eps'").select("cik", "fy", "pe_ratio", "market_cap")
