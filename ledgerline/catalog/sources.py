"""Readers on documents that Spark writes from the tables, sinks and streams."""

from pyspark.sql import functions as F

from ledgerline.catalog.metrics import INDUSTRY, RULES
from ledgerline.catalog.registry import query
from ledgerline.functions import concepts as C
from ledgerline.functions.labels import industry_class
from ledgerline.functions.ratios import with_ratios
from ledgerline.operators import compare as cp
from ledgerline.operators import ownership as ow
from ledgerline.operators import ranking as rk
from ledgerline.plans import fundamentals as plan
from ledgerline.sources import documents as sd
from ledgerline.sources import sinks
from ledgerline.streaming import streams as st


@query("company_facts_document", """
SELECT cik, concept, label, value, start_date, end_date, filed, form, accn, fy, fp, units, taxonomy FROM fx_facts
""")
def company_facts_document(i):
    return sd.company_facts(sd.nest_company_facts(i.fx_facts))


@query("ticker_directory", """
SELECT cik, name, ticker, CASE WHEN cik % 2 = 0 THEN exchange ELSE '' END AS exchange FROM fx_company
""")
def ticker_directory(i):
    c = i.fx_company.withColumn("part", (F.col("cik") / 100).cast("int"))
    s = lambda x: F.col(x).cast("string")
    # Half of the companies as a table of rows, half as keyed objects.
    table = c.where("cik % 2 = 0").groupBy("part").agg(F.collect_list(F.array(s("ticker"), s("cik"), s("name"), s("exchange"))).alias("data"))
    table = table.select(F.to_json(F.struct(F.array(*[F.lit(x) for x in ("ticker", "cik", "name", "exchange")]).alias("fields"), "data")).alias("json"))
    entry = F.struct(s("cik").alias("cik_str"), F.col("ticker"), F.col("name").alias("title"))
    keyed = c.where("cik % 2 = 1").groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(s("cik"), entry))).alias("m"))
    return sd.ticker_directory(table.unionByName(keyed.select(F.to_json("m").alias("json"))))


@query("columnar_filings", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filed DESC, accn) AS n, count(*) OVER (PARTITION BY cik) AS total FROM fx_filings)
SELECT cik, accn, form, cast(filed AS varchar) AS filed, CASE WHEN n = total THEN NULL WHEN lower(description) IN ('nan', 'none') THEN NULL ELSE description END AS description, coalesce(cast(report_date AS varchar), '') AS report_date FROM r
""")
def columnar_filings(i):
    from pyspark.sql import Window
    w = Window.partitionBy("cik").orderBy(F.col("filed").desc(), "accn")
    # Two pages that overlap by one filing; the last description is missing.
    rows = i.fx_filings.withColumns({"n": F.row_number().over(w), "total": F.count("*").over(Window.partitionBy("cik"))})
    rows = rows.withColumn("page", F.explode(F.when(F.col("n") == 50, F.array(F.lit(0), F.lit(1))).when(F.col("n") < 50, F.array(F.lit(0))).otherwise(F.array(F.lit(1)))))
    item = F.struct("n", "accn", "form", F.col("filed").cast("string").alias("filed"), "description", F.coalesce(F.col("report_date").cast("string"), F.lit("")).alias("report_date"), "total")
    g = rows.groupBy("cik", "page").agg(F.array_sort(F.collect_list(item)).alias("x"))
    col = lambda c: F.transform("x", lambda e: e[c]).alias(c)
    short = F.transform(F.filter("x", lambda e: e["n"] < e["total"]), lambda e: e["description"]).alias("description")
    return sd.columnar_filings(g.select("cik", "page", col("accn"), col("form"), col("filed"), short, col("report_date")))


def _form4(i):
    """Insider forms written from the events; options go to the second table."""
    val = lambda name, c: F.concat(F.lit(f"<{name}><value>"), c.cast("string"), F.lit(f"</value></{name}>"))
    t = i.fx_insider
    shares = F.col("shares").cast("decimal(18,0)")
    trade = F.concat(
        val("transactionDate", F.col("txn_date")), F.lit("<transactionCoding><transactionCode>"), "code", F.lit("</transactionCode></transactionCoding><transactionAmounts>"),
        val("transactionShares", shares), val("transactionPricePerShare", F.col("price").cast("decimal(18,2)")), F.lit("</transactionAmounts>"),
        F.lit("<postTransactionAmounts>"), val("sharesOwnedFollowingTransaction", shares + 5), F.lit("</postTransactionAmounts>"),
    )
    wrap = lambda tag: F.concat(F.lit(f"<{tag}Table><{tag}Transaction>"), trade, F.lit(f"</{tag}Transaction></{tag}Table>"))
    table = F.when(F.col("code").isin("M", "A"), wrap("derivative")).otherwise(wrap("nonDerivative"))
    n = F.col("accn")
    role = (
        F.when(n % 4 == 0, "<officerTitle>CFO</officerTitle>").when(n % 4 == 1, "<isDirector>1</isDirector>")
        .when(n % 4 == 2, "<isDirector>0</isDirector><isOfficer>true</isOfficer>").otherwise("<isTenPercentOwner>1</isTenPercentOwner>")
    )
    xml = F.concat(
        F.lit("<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>Owner "), "insider",
        F.lit("</rptOwnerName></reportingOwnerId><reportingOwnerRelationship>"), role,
        F.lit("</reportingOwnerRelationship></reportingOwner>"), table, F.lit("</ownershipDocument>"),
    )
    return t.select("cik", "accn", F.date_add("txn_date", 2).alias("filed"), xml.alias("xml"))


@query("insider_forms", """
SELECT cik, accn, txn_date + 2 AS filed, 'Owner ' || insider AS insider, CASE accn % 4 WHEN 0 THEN 'CFO' WHEN 1 THEN 'Director' WHEN 2 THEN 'Officer' ELSE '10% Owner' END AS title, txn_date,
 CASE code WHEN 'P' THEN 'Purchase' WHEN 'S' THEN 'Sale' WHEN 'M' THEN 'Option Exercise' WHEN 'A' THEN 'Grant/Award' WHEN 'G' THEN 'Gift' ELSE 'Deposit/withdrawal from voting trust' END AS transaction_type,
 coalesce(shares, 0) AS shares, price, cast(cast(shares AS decimal(18,4)) * cast(price AS decimal(18,4)) AS decimal(28,2))::double AS total_value,
 CASE WHEN code IN ('M', 'A') THEN NULL ELSE shares + 5 END AS shares_after, CASE WHEN code IN ('M', 'A') THEN 'derivative' ELSE 'non_derivative' END AS "table" FROM fx_insider WHERE price IS NOT NULL
""")
def insider_forms(i):
    return sd.insider_forms(_form4(i).where("xml IS NOT NULL"))


@query("holding_reports", """
WITH r AS (SELECT institution AS filer, upper(name) AS issuer, h.shares, cast(value AS decimal(18,0))::double AS v FROM fx_holdings h JOIN fx_company c ON h.cik = c.cik),
k AS (SELECT DISTINCT right(upper(name), 3) AS issuer_key FROM fx_company)
SELECT filer, issuer_key, sum(shares)::bigint AS shares, sum(v) * 1000 AS value FROM r JOIN k ON contains(issuer, issuer_key) GROUP BY filer, issuer_key
""")
def holding_reports(i):
    h = i.fx_holdings.join(i.fx_company.select("cik", "name"), "cik")
    row = F.concat(
        F.lit("<infoTable><nameOfIssuer>"), "name", F.lit("</nameOfIssuer><value>"), F.col("value").cast("decimal(18,0)").cast("string"),
        F.lit("</value><shrsOrPrnAmt><sshPrnamt>"), F.col("shares").cast("bigint").cast("string"), F.lit("</sshPrnamt></shrsOrPrnAmt></infoTable>"),
    )
    # One report per filer and hundred companies, as filers split long lists.
    g = h.groupBy(F.col("institution").alias("filer"), (F.col("cik") / 100).cast("int").alias("part")).agg(F.array_join(F.collect_list(row), "").alias("body"))
    docs = g.select("filer", F.concat(F.lit("<informationTable>"), "body", F.lit("</informationTable>")).alias("xml"))
    keys = i.fx_company.select(F.upper(F.right("name", F.lit(3))).alias("issuer_key")).distinct()
    return sd.holding_reports(docs, keys)


def _bar(**extra):
    t = (F.unix_timestamp(F.col("day").cast("timestamp")) * 1000)
    return F.struct(*[v.alias(k) for k, v in extra.items()], t.alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"),
                    F.when(F.col("volume") % 5 != 0, F.col("close")).alias("c"), F.col("volume").cast("double").alias("v"))


@query("price_bars", 'SELECT symbol, day, open, high, low, close, volume FROM fx_bars WHERE volume % 5 <> 0')
def price_bars(i):
    docs = i.fx_bars.groupBy("symbol").agg(F.to_json(F.struct(F.collect_list(_bar()).alias("results"))).alias("json"))
    return sd.price_bars(docs)


@query("grouped_daily_bars", "SELECT upper(symbol) AS symbol, day, open, high, low, CASE WHEN volume % 5 <> 0 THEN close END AS close, volume FROM fx_bars")
def grouped_daily_bars(i):
    docs = i.fx_bars.groupBy("day").agg(F.to_json(F.struct(F.collect_list(_bar(T=F.col("symbol"))).alias("results"))).alias("json"))
    return sd.grouped_bars(docs)


@query("news_articles", """
SELECT 'T' || (doc_id % 50) AS symbol, left(text, 20) AS title, source AS publisher, timestamp '2024-01-01 00:00:00' + to_days((doc_id % 30)::int) AS published, 'http://news/' || doc_id AS url, 2 AS n_tickers,
 CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' END AS sentiment FROM documents
""")
def news_articles(i):
    d = F.col("doc_id")
    symbol = F.concat(F.lit("T"), (d % 50).cast("string"))
    mood = F.when(d % 3 == 0, "positive").when(d % 3 == 1, "negative")
    mine = F.struct(F.when(d % 3 == 2, "OTHER").otherwise(symbol).alias("ticker"), F.coalesce(mood, F.lit("neutral")).alias("sentiment"))
    other = F.struct(F.lit("ZZ").alias("ticker"), F.lit("neutral").alias("sentiment"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (d % 30).cast("int"))
    doc = F.struct(
        F.expr("left(text, 20)").alias("title"), F.struct(F.col("source").alias("name")).alias("publisher"),
        F.concat(day.cast("string"), F.lit("T00:00:00Z")).alias("published_utc"), F.concat(F.lit("http://news/"), d.cast("string")).alias("article_url"),
        F.array(symbol, F.lit("ZZ")).alias("tickers"), F.array(other, mine).alias("insights"),
    )
    return sd.news_articles(i.documents.select(symbol.alias("symbol"), F.to_json(doc).alias("json")))


@query("vendor_segment_history", "SELECT cast(cik AS varchar) AS symbol, make_date(fy, 12, 31) AS end_date, fy, 'FY' AS period, label, value FROM fx_dims WHERE axis = 'StatementGeographicalAxis' AND value > 0")
def vendor_segment_history(i):
    d = i.fx_dims.where("axis = 'StatementGeographicalAxis'")
    g = d.groupBy("cik", "fy").agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("data"))
    doc = F.struct(F.make_date("fy", F.lit(12), F.lit(31)).cast("string").alias("date"), F.col("fy").alias("fiscalYear"), "data")
    return sd.segment_history(g.select(F.col("cik").cast("string").alias("symbol"), F.to_json(doc).alias("json")))


@query("dividend_documents", "SELECT symbol, cast(close AS decimal(12,2))::double AS cash_amount, 'USD' AS currency, day AS ex_date, day + 10 AS pay_date, 4 AS frequency FROM fx_bars")
def dividend_documents(i):
    doc = F.struct(F.col("close").cast("decimal(12,2)").alias("cash_amount"), F.lit("USD").alias("currency"), F.col("day").cast("string").alias("ex_dividend_date"),
                   F.date_add("day", 10).cast("string").alias("pay_date"), F.lit(4).alias("frequency"))
    return sd.dividends(i.fx_bars.select("symbol", F.to_json(doc).alias("json")))


@query("split_documents", "SELECT symbol, day AS executed, 1.0::double AS split_from, (volume % 4 + 2)::double AS split_to FROM fx_bars")
def split_documents(i):
    doc = F.struct(F.col("day").cast("string").alias("execution_date"), F.lit(1).alias("split_from"), (F.col("volume") % 4 + 2).alias("split_to"))
    return sd.splits(i.fx_bars.select("symbol", F.to_json(doc).alias("json")))


@query("dimension_scan", "SELECT axis, count(*) AS n, count(DISTINCT label) AS members FROM fx_dims GROUP BY axis")
def dimension_scan(i):
    return i.fx_dims.groupBy("axis").agg(F.count("*").alias("n"), F.countDistinct("label").alias("members"))


@query("csv_export_roundtrip", """
WITH a AS (SELECT * FROM fx_wide WHERE fy = 2000), b AS (SELECT * FROM fx_wide WHERE fy = 1999)
SELECT a.cik, 0 AS line_no, 'revenue' AS metric_name, a.revenue AS current_value, b.revenue AS prior_value, cast((a.revenue - b.revenue) / abs(b.revenue) * 100 AS decimal(28,2))::double AS change_pct FROM a LEFT JOIN b ON a.cik = b.cik
UNION ALL SELECT cik, 1, 'ratio_net_margin', net_income / revenue, NULL, NULL FROM a
""")
def csv_export_roundtrip(i):
    now, before = i.fx_wide.where("fy = 2000"), i.fx_wide.where("fy = 1999")
    rows = cp.export_rows(with_ratios(now), before, ["revenue"], ["net_margin"])
    folder = st.work_folder(i.spark, "csv")
    sinks.write_csv(rows, folder)
    return i.spark.read.schema(rows.schema).option("header", True).csv(folder)


@query("json_export_roundtrip", "SELECT cik, revenue, net_income, total_assets FROM fx_wide WHERE fy = 2000")
def json_export_roundtrip(i):
    docs = sinks.company_documents(i.fx_wide.where("fy = 2000"), {"income": ["revenue", "net_income"], "balance": ["total_assets"]})
    folder = st.work_folder(i.spark, "json")
    sinks.write_json(docs, folder)
    back = i.spark.read.schema("cik long, income struct<revenue:double,net_income:double>, balance struct<total_assets:double>").json(folder)
    return back.select("cik", "income.revenue", "income.net_income", "balance.total_assets")


@query("comparison_snapshot", """
WITH v AS (SELECT c.ticker, fy, metric, value FROM fx_long l JOIN fx_company c ON l.cik = c.cik WHERE metric IN ('revenue', 'net_income', 'gross_profit'))
SELECT 'first' AS batch, ticker, fy, metric, value FROM v WHERE fy <= 1998
UNION ALL SELECT 'second', ticker, fy, metric, value FROM v WHERE fy >= 1997
""")
def comparison_snapshot(i):
    """Two snapshots appended, the first one twice, as a retry would; the sink holds each once."""
    long = i.fx_long.join(i.fx_company.select("cik", "ticker"), "cik")
    sink = sinks.SnapshotSink(st.work_folder(i.spark, "snapshots"))
    for batch, rows in (("first", "fy <= 1998"), ("first", "fy <= 1998"), ("second", "fy >= 1997")):
        sink.append(sinks.comparison_snapshot(long.where(rows), ["revenue", "net_income", "gross_profit"]), batch)
    return sink.read(i.spark).select("batch", "ticker", "fy", F.inline("metrics"))


OBS = "SELECT cik, metric, period_type, end_date, value FROM (SELECT *, row_number() OVER (PARTITION BY cik, metric, period_type, end_date ORDER BY batch DESC) AS rn FROM fx_obs) t WHERE rn = 1"
KEY = ["cik", "metric", "period_type", "end_date"]


@query("upsert_observations", OBS)
def upsert_observations(i):
    obs = i.fx_obs
    table = sinks.latest_wins(obs.where("batch <= 1"), KEY, [F.col("batch").desc()]).select(*KEY, "value")
    updates = sinks.latest_wins(obs.where("batch > 1"), KEY, [F.col("batch").desc()]).select(*KEY, "value")
    return sinks.upsert(table, updates, KEY)


@query("stream_upsert_observations", OBS)
def stream_upsert_observations(i):
    folder = st.work_folder(i.spark, "observations")
    for b in range(5):
        i.fx_obs.where(F.col("batch") == b).write.mode("append").parquet(f"{folder}/in")
    # A micro-batch may hold files of several batches: the batch number orders the versions of a key.
    stream = st.open_stream(i.spark, f"{folder}/in", files_per_batch=16)
    table = st.upsert_stream(stream, f"{folder}/table", KEY, f"{folder}/state", order=["batch"])
    return table.read(i.spark).select(*KEY, "value")


def _event_stream(i):
    return st.open_stream(i.spark, f"{i.sf_dir}/events*.parquet")


@query("stream_new_filings", "SELECT DISTINCT event_id, cast(user_id % 10 + 1 AS bigint) AS cik FROM events")
def stream_new_filings(i):
    events = _event_stream(i)
    # Every filing is announced twice; the repeat falls inside the watermark.
    twice = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    out = st.new_filings(twice, ["event_id"]).select("event_id", (F.col("user_id") % 10 + 1).cast("long").alias("cik"))
    return st.drain(out, "filings")


WINDOW_SQL = """
WITH t AS (SELECT cast(user_id % 10 + 1 AS bigint) AS cik, ts, event_type, cast(cast(value * 10 AS decimal(12,0)) AS decimal(18,2)) AS shares FROM events),
w AS (SELECT *, {start} AS start FROM t{source}),
m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT start, start + INTERVAL {days} DAY AS "end", cik, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS buys, count(CASE WHEN event_type = 'signup' THEN 1 END) AS sells,
 sum(CASE event_type WHEN 'purchase' THEN shares WHEN 'signup' THEN -shares ELSE 0 END)::double AS net_shares FROM w, m WHERE start + INTERVAL {days} DAY <= mark GROUP BY start, cik
"""


def _trades(i):
    kind = F.when(F.col("event_type") == "purchase", "Purchase").when(F.col("event_type") == "signup", "Sale").otherwise("Other")
    shares = (F.col("value") * 10).cast("decimal(12,0)").cast("double")
    return _event_stream(i).select((F.col("user_id") % 10 + 1).cast("long").alias("cik"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("transaction_type"), shares.alias("shares"))


@query("stream_insider_daily", WINDOW_SQL.format(start="date_trunc('day', ts)::timestamp", source="", days=1))
def stream_insider_daily(i):
    out = st.insider_windows(_trades(i), "1 day", None)
    return _plain(st.drain(out, "insider-daily"))


@query("stream_insider_sliding", WINDOW_SQL.format(start="date_trunc('day', ts)::timestamp - to_days(k::int)", source=", (SELECT unnest(range(0, 7)) AS k) g", days=7))
def stream_insider_sliding(i):
    out = st.insider_windows(_trades(i), "7 days", "1 day")
    return _plain(st.drain(out, "insider-sliding"))


def _sliding_sql(days):
    return WINDOW_SQL.format(start="date_trunc('day', ts)::timestamp - to_days(k::int)", source=f", (SELECT unnest(range(0, {days})) AS k) g", days=days)


@query("stream_insider_30_days", _sliding_sql(30))
def stream_insider_30_days(i):
    return _plain(st.drain(st.insider_windows(_trades(i), "30 days", "1 day"), "insider-30"))


@query("stream_insider_90_days", _sliding_sql(90))
def stream_insider_90_days(i):
    return _plain(st.drain(st.insider_windows(_trades(i), "90 days", "1 day"), "insider-90"))


def _plain(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_daily_bars", """
WITH e AS (SELECT event_type || '-' || cast(user_id % 20 AS varchar) AS symbol, ts, value, ts - INTERVAL 5 HOUR AS l FROM events),
s AS (SELECT *, CASE WHEN isodow(l) >= 6 OR cast(l AS date) IN (date '2024-01-01', date '2024-01-15') THEN 'closed' WHEN hour(l) * 60 + minute(l) BETWEEN 240 AND 569 THEN 'pre' WHEN hour(l) * 60 + minute(l) BETWEEN 570 AND 959 THEN 'regular' WHEN hour(l) * 60 + minute(l) BETWEEN 960 AND 1199 THEN 'after' ELSE 'closed' END AS session FROM e)
SELECT cast(ts AS date) AS day, symbol, session, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM s
WHERE cast(ts AS date) + 1 <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2, 3
""")
def stream_daily_bars(i):
    symbol = F.concat_ws("-", "event_type", (F.col("user_id") % 20).cast("string"))
    events = _event_stream(i).select(symbol.alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return st.drain(st.daily_bars(events), "bars")


@query("historical_extract", """
WITH p AS (SELECT cik, form, accn, max(end_date) AS report_date, min(filed) AS filed FROM fx_facts WHERE taxonomy <> 'dei' AND end_date <= filed GROUP BY cik, form, accn),
c AS (SELECT * FROM p),
f AS (SELECT c.cik, c.accn, c.form, c.report_date, concept, value, DAYS(end_date, start_date) AS dur FROM fx_facts f JOIN c ON f.cik = c.cik AND f.accn = c.accn AND f.end_date = c.report_date
  WHERE dimension IS NULL AND (units = 'shares' OR units = CASE WHEN c.cik % 10 = 9 THEN 'EUR' ELSE 'USD' END)),
n AS (SELECT *, row_number() OVER (PARTITION BY cik, accn, concept ORDER BY dur DESC NULLS LAST, value) AS longest FROM f),
r(tag, priority) AS (VALUES """ + ", ".join(f"('{r.tag}', {r.priority})" for r in C.default_rules() if r.metric == "revenue" and r.industry in ("*", "standard") and not r.aggregate) + """),
o AS (SELECT cik, accn, 1 AS step, priority, 0.0 AS size, value FROM n JOIN r ON concept = tag WHERE longest = 1
  UNION ALL SELECT cik, accn, 3, 0, -abs(value), value FROM n WHERE longest = 1 AND NOT regexp_matches(concept, '(?i)(""" + "|".join(C.FORECAST_WORDS) + """)') AND regexp_matches(concept, '(?i)(_Revenues$|_Revenue$|_TotalRevenue$|_TotalRevenues$)')),
v AS (SELECT cik, accn, value AS revenue FROM (SELECT *, row_number() OVER (PARTITION BY cik, accn ORDER BY step, priority, size) AS k FROM o) x WHERE k = 1)
SELECT c.cik, c.accn, c.form, c.report_date, max(v.revenue) AS revenue, max(CASE WHEN concept = 'NetIncomeLoss' AND longest = 1 THEN value END) AS net_income, max(CASE WHEN concept = 'Assets' THEN value END) AS total_assets,
 max(CASE WHEN concept = 'NetIncomeLoss' AND longest = 1 THEN value END) / nullif(max(v.revenue), 0) AS net_margin,
 max(CASE WHEN concept = 'NetIncomeLoss' AND longest = 1 THEN value END) / max(CASE WHEN concept = 'Assets' THEN value END) AS return_on_assets
FROM c JOIN n ON c.cik = n.cik AND c.accn = n.accn LEFT JOIN v ON c.cik = v.cik AND c.accn = v.accn GROUP BY c.cik, c.accn, c.form, c.report_date
""")
def historical_extract(i):
    out = plan.historical_extract(i.fx_facts)
    return out.select("cik", "accn", "form", "report_date", "revenue", "net_income", "total_assets", "net_margin", "return_on_assets")


# Annual filings that tag most of what the rules know: some tags prefixed, in some filings only, and some
# repeated in a second currency.
TAGS = tuple(dict.fromkeys(r.tag for r in C.default_rules()))
HISTORY = f"""
WITH t(tag, idx) AS (VALUES {", ".join(f"('{t}', {k})" for k, t in enumerate(TAGS))}),
k AS (SELECT cik, accn, report_date, cast(year(report_date) AS int) AS y FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filed DESC, accn) AS rn FROM fx_filings WHERE form = '10-K') x WHERE rn <= 3),
class AS (SELECT cik, {INDUSTRY} AS industry FROM fx_company),
d AS (SELECT k.cik, k.accn, industry, CASE WHEN (idx + k.cik + y) % 7 = 0 THEN 'acme:' ELSE '' END || tag AS concept, tag AS bare, cast(idx * 1000 + k.cik + y AS double) AS value
  FROM k JOIN class ON class.cik = k.cik, t WHERE (k.cik + idx) % 4 <> 0),
{RULES},
h AS (SELECT d.cik, accn, r.metric, r.priority, r.agg, d.value, r.display, d.concept = r.tag AS direct, r.tag FROM d JOIN rules r ON d.bare = r.tag AND r.ind IN ('*', d.industry)),
u AS (SELECT DISTINCT cik, tag FROM h WHERE direct),
cand AS (SELECT cik, accn, metric, agg, priority, value, display, concat(cik, tag) IN (SELECT concat(cik, tag) FROM u) AS used, direct FROM h),
best AS (SELECT *, row_number() OVER (PARTITION BY cik, accn, metric ORDER BY priority, display, value) AS rn FROM cand WHERE agg = 0 AND (direct OR NOT used)),
parts AS (SELECT cik, accn, metric, sum(cast(value AS decimal(28, 4)))::double AS value, string_agg(display, ' + ' ORDER BY priority) AS source, least(0.85, 0.60 + 0.05 * count(*))::double AS confidence
  FROM cand WHERE agg = 1 AND (direct OR NOT used) GROUP BY cik, accn, metric)
SELECT cik, accn, metric, value, display AS source, 0.99::double AS confidence, 'exact' AS method FROM best WHERE rn = 1
UNION ALL SELECT cik, accn, metric, value, source, confidence, 'aggregate' FROM parts p
  WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.cik = p.cik AND b.accn = p.accn AND b.metric = p.metric)
"""


def _dense_filings(i):
    """Facts of annual filings for nearly every tag of the rules, with a second currency beside some of them."""
    tags = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(k).alias("idx")) for k, t in enumerate(TAGS)]))
    f = i.fx_filings.where("form = '10-K'").select("cik", "accn", "filed", F.col("report_date").alias("end_date"), tags.alias("t"))
    f = f.select("*", "t.*", F.year("end_date").alias("y")).where("(cik + idx) % 4 <> 0")
    concept = F.concat(F.when((F.col("idx") + F.col("cik") + F.col("y")) % 7 == 0, "acme:").otherwise(""), "tag")
    own, other = (F.when((F.col("cik") % 10 == 9) == own, "EUR").otherwise("USD") for own in (True, False))
    value = (F.col("idx") * 1000 + F.col("cik") + F.col("y")).cast("double")
    # Both currencies of a row come from it at once: a union would read the filings twice.
    second = F.when(F.col("idx") % 5 == 0, F.struct(other.alias("units"), (value / 16).alias("value")))
    amounts = F.array_compact(F.array(F.struct(own.alias("units"), value.alias("value")), second))
    return f.select("*", F.inline(amounts)).select(
        "cik", F.lit("us-gaap").alias("taxonomy"), concept.alias("concept"), "units", F.make_date("y", F.lit(1), F.lit(1)).alias("start_date"),
        "end_date", "filed", "accn", F.col("y").alias("fy"), F.lit("FY").alias("fp"), F.lit("10-K").alias("form"), "value",
        F.lit(None).cast("string").alias("dimension"),
    )


@query("historical_metrics", HISTORY)
def historical_metrics(i):
    industry = i.fx_company.select("cik", industry_class("sic", "ticker").alias("industry"))
    return plan.historical_metrics(_dense_filings(i), {"10-K": 3}, 4, industry)


@query("metric_subset", "SELECT cik, end_date, revenue, ebitda FROM fx_wide")
def metric_subset(i):
    return plan.metric_subset(i.fx_wide, ["revenue", "ebitda"])
