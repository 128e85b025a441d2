"""Price bars, breadth, sectors, sessions, insiders and holders."""

from pyspark.sql import functions as F

from ledgerline.catalog.registry import query
from ledgerline.functions.dates import filing_desk_open, market_session
from ledgerline.operators import market as mk
from ledgerline.operators import ownership as ow

RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS n FROM fx_bars WHERE close IS NOT NULL)"
SIGNALS = f"""{RANKED}, s AS (SELECT symbol, max(CASE WHEN n = 1 THEN close END) AS last, max(CASE WHEN n = 2 THEN close END) AS previous, max(close) AS high, min(close) AS low,
  avg(CASE WHEN n <= 10 THEN cast(close AS decimal(28,6)) END)::double AS sma, count(*) AS n_bars FROM r GROUP BY symbol HAVING count(*) >= 2)"""


@query("closing_signals", f"WITH {SIGNALS} SELECT symbol, last, previous, high, low, round(sma, 4) AS sma, n_bars FROM s")
def closing_signals(i):
    return mk.closing_signals(i.fx_bars, 10).withColumn("sma", F.round("sma", 4))


@query("market_breadth", f"""
WITH {SIGNALS.replace('n <= 10', 'n <= 50')}
SELECT count(CASE WHEN last > previous THEN 1 END) AS advancers, count(CASE WHEN last < previous THEN 1 END) AS decliners,
 cast(count(CASE WHEN last > previous THEN 1 END) / nullif(count(CASE WHEN last < previous THEN 1 END), 0) AS decimal(28,2))::double AS adv_dec_ratio,
 count(CASE WHEN last >= high THEN 1 END) AS new_highs, count(CASE WHEN last <= low THEN 1 END) AS new_lows,
 cast(count(CASE WHEN last > sma THEN 1 END) / count(*) * 100 AS decimal(28,1))::double AS pct_above_average,
 cast(count(*) / (SELECT count(DISTINCT symbol) FROM fx_bars) AS decimal(28,3))::double AS coverage FROM s
""")
def market_breadth(i):
    bars = i.fx_bars
    return mk.market_breadth(bars, bars.select("symbol").distinct())


COMPANY = "c AS (SELECT DISTINCT b.symbol, k.shares, k.sector FROM fx_bars b JOIN fx_company k ON b.cik = k.cik)"


@query("sector_rollup", f"""
WITH {RANKED}, {COMPANY}, l AS (SELECT symbol, max(CASE WHEN n = 1 THEN close END) AS last, max(CASE WHEN n = 2 THEN close END) AS previous FROM r GROUP BY symbol),
x AS (SELECT l.*, sector, cast(last * shares AS decimal(28,6)) AS cap FROM l JOIN c ON l.symbol = c.symbol),
y AS (SELECT *, cast(cap::double * coalesce((last - previous) / nullif(previous, 0) * 100, 0) AS decimal(28,4)) AS chg, row_number() OVER (PARTITION BY sector ORDER BY cap DESC, symbol DESC) AS rn FROM x),
t AS (SELECT sum(cap)::double AS total FROM x)
SELECT sector, NULL::varchar AS fund, cast(sum(cap)::double / max(total) * 100 AS decimal(28,2))::double AS weight_pct, count(*) AS n_members, cast(sum(chg)::double / sum(cap)::double AS decimal(28,2))::double AS avg_change_pct,
 string_agg(CASE WHEN rn <= 15 THEN symbol END, ',' ORDER BY rn) AS members FROM y, t GROUP BY sector
""")
def sector_rollup(i):
    company = i.fx_bars.select("symbol", "cik").distinct().join(i.fx_company.select("cik", "shares", "sector"), "cik")
    out = mk.sector_rollup(i.fx_bars, company.select("symbol", "shares", "sector"))
    return out.withColumn("members", F.array_join("members", ","))


@query("top_sector_members", f"""
WITH {RANKED}, {COMPANY}, x AS (SELECT r.symbol, sector, cast(close * shares AS decimal(28,6)) AS cap FROM r JOIN c ON r.symbol = c.symbol WHERE n = 1)
SELECT sector, symbol, cast(rn AS int) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY cap DESC, symbol DESC) AS rn FROM x) y WHERE rn <= 3
""")
def top_sector_members(i):
    company = i.fx_bars.select("symbol", "cik").distinct().join(i.fx_company.select("cik", "shares", "sector"), "cik")
    out = mk.sector_rollup(i.fx_bars, company.select("symbol", "shares", "sector"), members=3)
    return out.select("sector", F.posexplode("members").alias("p", "symbol")).select("sector", "symbol", (F.col("p") + 1).alias("rn"))


@query("price_window", """
WITH e AS (SELECT *, max(day) OVER (PARTITION BY symbol) AS last_day FROM fx_bars), w AS (SELECT * FROM e WHERE day > last_day - 14)
SELECT symbol, min(day) AS start, max(day) AS "end", min_by(close, day) AS start_close, max_by(close, day) AS end_close, max(high) AS high, min(low) AS low, count(*) AS n_bars,
 cast((max_by(close, day) - min_by(close, day)) / nullif(min_by(close, day), 0) * 100 AS decimal(28,2))::double AS change_pct FROM w GROUP BY symbol
""")
def price_window(i):
    return mk.price_window(i.fx_bars, 14)


@query("day_change", """
SELECT symbol, day, close, close - nullif(p, 0) AS change, (close - p) / nullif(p, 0) * 100 AS change_pct FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS p FROM fx_bars) t
""")
def day_change(i):
    return mk.day_change(i.fx_bars)


EASTERN = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"
HOLIDAY = "cast(l AS date) IN (date '2024-01-01', date '2024-01-15')"
SESSION = f"CASE WHEN isodow(l) >= 6 OR {HOLIDAY} THEN 'closed' WHEN m >= 240 AND m < 570 THEN 'pre' WHEN m >= 570 AND m < 960 THEN 'regular' WHEN m >= 960 AND m < 1200 THEN 'after' ELSE 'closed' END"


# All events are in January 2024, so Eastern time is UTC less five hours.
@query("market_session", f"""
WITH t AS (SELECT event_id, ts - INTERVAL 5 HOUR AS l FROM events), u AS (SELECT *, hour(l) * 60 + minute(l) AS m FROM t)
SELECT event_id, {SESSION} AS session, isodow(l) < 6 AND NOT {HOLIDAY} AND hour(l) BETWEEN 6 AND 21 AS filing_desk_open FROM u
""")
def market_sessions(i):
    return i.events.select("event_id", market_session("ts").alias("session"), filing_desk_open("ts").alias("filing_desk_open"))


@query("stitch_index_level", f"""
WITH h AS (SELECT symbol, day, close AS level FROM fx_bars WHERE day <= date '2024-01-26'),
l AS (SELECT event_type || '-' || cast(user_id % 20 AS varchar) AS symbol, max(ts) AS now, max_by(value, ts) AS level FROM events WHERE value IS NOT NULL GROUP BY 1),
s AS (SELECT symbol, level, now - INTERVAL 5 HOUR AS l, hour(now - INTERVAL 5 HOUR) * 60 + minute(now - INTERVAL 5 HOUR) AS m FROM l),
d AS (SELECT *, cast(l AS date) - CASE WHEN ({SESSION}) = 'closed' AND hour(l) < 9 THEN 1 ELSE 0 END AS day0 FROM s),
x AS (SELECT symbol, level, cast(day0 - CASE isodow(day0) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS date) AS day FROM d)
SELECT * FROM h UNION ALL SELECT x.symbol, x.day, x.level FROM x JOIN (SELECT symbol, max(day) AS last_day FROM h GROUP BY symbol) m ON x.symbol = m.symbol AND x.day > last_day
""")
def stitch_index_level(i):
    history = i.fx_bars.where("day <= date '2024-01-26'").select("symbol", "day", F.col("close").alias("level"))
    symbol = F.concat_ws("-", "event_type", (F.col("user_id") % 20).cast("string"))
    live = i.events.where("value IS NOT NULL").groupBy(symbol.alias("symbol")).agg(
        F.max("ts").alias("now"), F.max_by("value", "ts").alias("level"))
    return mk.stitch_level(history, live.withColumn("session", market_session("now")))


@query("forward_dividend", """
WITH d AS (SELECT symbol, day AS ex_date, cast(close / 100 AS decimal(28,4))::double AS cash_amount, CASE WHEN volume % 3 = 0 THEN NULL WHEN volume % 3 = 1 THEN 4 ELSE 12 END AS frequency, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM fx_bars),
p AS (SELECT symbol, max_by(close, day) AS price FROM fx_bars GROUP BY symbol),
f AS (SELECT d.symbol, ex_date, cast(nullif(cash_amount, 0) * frequency AS decimal(28,4))::double AS forward_dividend, price FROM d JOIN p ON d.symbol = p.symbol WHERE rn = 1)
SELECT symbol, ex_date, forward_dividend, cast(forward_dividend / nullif(price, 0) * 100 AS decimal(28,2))::double AS yield_pct FROM f
""")
def forward_dividend(i):
    amount = (F.col("close") / 100).cast("decimal(28,4)").cast("double")
    freq = F.when(F.col("volume") % 3 == 1, 4).when(F.col("volume") % 3 == 2, 12)
    divs = i.fx_bars.select("symbol", F.col("day").alias("ex_date"), amount.alias("cash_amount"), freq.alias("frequency"))
    prices = i.fx_bars.groupBy("symbol").agg(F.max_by("close", "day").alias("price"))
    return mk.forward_dividend(divs, prices)


@query("split_ratio_text", "SELECT p_partkey, cast(p_size AS varchar) || '-for-' || cast(p_size % 7 + 1 AS varchar) AS ratio FROM part")
def split_ratio_text(i):
    return i.part.select("p_partkey", mk.split_text(F.col("p_size"), F.col("p_size") % 7 + 1).alias("ratio"))


TYPED = """t AS (SELECT *, CASE code WHEN 'P' THEN 'Purchase' WHEN 'S' THEN 'Sale' WHEN 'M' THEN 'Option Exercise' WHEN 'A' THEN 'Grant/Award' WHEN 'G' THEN 'Gift' WHEN 'Z' THEN 'Deposit/withdrawal from voting trust' END AS transaction_type,
  cast(cast(shares AS decimal(18,4)) * cast(price AS decimal(18,4)) AS decimal(28,2))::double AS total_value FROM fx_insider)"""


def _typed(i):
    return ow.with_total_value(i.fx_insider.withColumn("transaction_type", ow.transaction_type(F.col("code"))))


LAST = "(SELECT max(cast(ts AS date)) FROM events)"


def _last_day(i):
    """The newest event day, a scalar subquery of the same plan."""
    return i.events.agg(F.max(F.to_date("ts"))).scalar()


@query("transaction_types", f"""
WITH {TYPED} SELECT code, transaction_type, CASE WHEN code = 'P' THEN 'buy' WHEN code = 'S' THEN 'sell' ELSE 'other' END AS side, count(*) AS n FROM t GROUP BY 1, 2, 3
""")
def transaction_types(i):
    t = _typed(i)
    return t.groupBy("code", "transaction_type", ow.trade_side(F.col("transaction_type")).alias("side")).agg(F.count("*").alias("n"))


@query("insider_summary", f"""
WITH {TYPED}, a AS (SELECT cik, count(CASE WHEN code = 'P' THEN 1 END) AS buys, count(CASE WHEN code = 'S' THEN 1 END) AS sells, sum(CASE code WHEN 'P' THEN shares WHEN 'S' THEN -shares ELSE 0 END) AS net_shares
  FROM t WHERE txn_date >= {LAST} - 20 GROUP BY cik)
SELECT *, CASE WHEN buys > sells AND net_shares > 0 THEN 'Buying' WHEN sells > buys AND net_shares < 0 THEN 'Selling' ELSE 'Neutral' END AS sentiment FROM a
""")
def insider_summary(i):
    return ow.insider_summary(_typed(i), _last_day(i), 20)


@query("insider_activity", f"""
WITH {TYPED} SELECT cik, count(CASE WHEN code = 'P' THEN 1 END) AS buy_count, count(CASE WHEN code = 'S' THEN 1 END) AS sell_count, count(CASE WHEN code NOT IN ('P', 'S') THEN 1 END) AS other_count,
 sum(CASE code WHEN 'P' THEN shares WHEN 'S' THEN -shares ELSE 0 END) AS net_shares FROM t GROUP BY cik
""")
def insider_activity(i):
    return ow.insider_activity(_typed(i))


@query("notable_transactions", f"""
WITH {TYPED} SELECT cik, accn, total_value, cast(rn AS int) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY abs(total_value) DESC, accn) AS rn FROM t WHERE txn_date >= {LAST} - 90 AND total_value IS NOT NULL) x WHERE rn <= 5
""")
def notable_transactions(i):
    return ow.notable_transactions(_typed(i), _last_day(i)).select("cik", "accn", "total_value", "rn")


@query("combined_transaction_tables", """
SELECT cik, CASE WHEN code IN ('M', 'A') THEN 'derivative' ELSE 'non_derivative' END AS "table", count(*) AS n, sum(shares) AS shares FROM fx_insider GROUP BY 1, 2
""")
def combined_transaction_tables(i):
    t = i.fx_insider
    both = ow.combine_tables(t.where("code NOT IN ('M', 'A')"), t.where("code IN ('M', 'A')"))
    return both.groupBy("cik", "table").agg(F.count("*").alias("n"), F.sum("shares").alias("shares"))


@query("holder_families", """
SELECT cik, split_part(institution, ' ', 1) AS family, sum(cast(pct AS decimal(28,2)))::double AS pct, sum(cast(shares AS decimal(28,2)))::double AS shares, string_agg(institution, '|' ORDER BY institution) AS entities
FROM fx_holdings GROUP BY 1, 2 HAVING sum(cast(pct AS decimal(28,2))) > 0
""")
def holder_families(i):
    return ow.holder_families(i.fx_holdings).withColumn("entities", F.array_join("entities", "|"))


@query("issuer_positions", """
SELECT cik, count(*) AS filers, sum(cast(shares AS decimal(28,2)))::double AS shares, sum(cast(value AS decimal(28,2)))::double AS value FROM fx_holdings GROUP BY cik
""")
def issuer_positions(i):
    h = i.fx_holdings
    # Older reports of the same filers must not be counted again.
    older = h.withColumns({"filed": F.date_sub("filed", 90), "shares": F.col("shares") * 3})
    return ow.issuer_positions(h.unionByName(older))


@query("beneficial_filings", "SELECT cik, accn, form, 'passive' AS kind FROM fx_filings WHERE form LIKE 'SC 13%'")
def beneficial_filings(i):
    return ow.beneficial_filings(i.fx_filings).select("cik", "accn", "form", "kind")
