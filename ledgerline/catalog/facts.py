"""Facts layer: filters, dedupe and period selection."""

from pyspark.sql import functions as F

from ledgerline.catalog.registry import query
from ledgerline.functions.dates import duration_class
from ledgerline.operators import facts as fx

FACT_COLS = "cik, concept, units, start_date, end_date, filed, accn, value"
NO_DUP = """row_number() OVER (PARTITION BY cik, concept, taxonomy, units, start_date, end_date
    ORDER BY filed DESC NULLS LAST, accn DESC NULLS LAST, value DESC NULLS LAST)"""


def _cols(df):
    return df.select(*[c.strip() for c in FACT_COLS.split(",")])


DEDUPED = f"(SELECT * FROM (SELECT *, {NO_DUP} AS rn FROM fx_facts WHERE dimension IS NULL) d WHERE rn = 1)"
DUR = "DAYS(end_date, start_date)"


@query("dedupe_facts", f"""
SELECT {FACT_COLS} FROM (SELECT *, {NO_DUP} AS rn FROM fx_facts WHERE dimension IS NULL) d WHERE rn = 1
""")
def dedupe_facts(i):
    return _cols(fx.dedupe_facts(i.fx_facts.where("dimension IS NULL")))


@query("quality_filter", """
WITH f AS (SELECT *, (dimension IS NULL OR trim(dimension) = '') AND NOT (concept LIKE '%Axis' OR concept LIKE '%Member'
   OR concept LIKE '%TextBlock%') AS ok FROM fx_facts),
g AS (SELECT *, max(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY cik) AS any_ok FROM f)
SELECT cik, concept, count(*) AS n, sum(cast(value AS decimal(28,4)))::double AS total
FROM g WHERE ok OR any_ok = 0 GROUP BY cik, concept
""")
def quality_filter(i):
    good = fx.quality_filter(i.fx_facts)
    return good.groupBy("cik", "concept").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("total")
    )


@query("quality_filter_keeps_empty_groups", """
WITH f AS (SELECT * FROM fx_facts WHERE concept LIKE '%TextBlock' OR cik % 2 = 0),
g AS (SELECT *, CASE WHEN dimension IS NULL AND NOT (concept LIKE '%Axis' OR concept LIKE '%TextBlock%') THEN 1 ELSE 0 END AS ok FROM f),
h AS (SELECT *, max(ok) OVER (PARTITION BY cik) AS any_ok FROM g)
SELECT cik, concept, count(*) AS n FROM h WHERE ok = 1 OR any_ok = 0 GROUP BY cik, concept
""")
def quality_filter_keeps_empty_groups(i):
    # Companies left with narrative rows only must keep them.
    some = i.fx_facts.where("concept LIKE '%TextBlock' OR cik % 2 = 0")
    return fx.quality_filter(some).groupBy("cik", "concept").agg(F.count("*").alias("n"))


@query("form_filter", f"SELECT {FACT_COLS} FROM fx_facts WHERE form IN ('10-K')")
def form_filter(i):
    return _cols(fx.form_filter(i.fx_facts, ["10-K"]))


@query("detect_currency", """
WITH c AS (SELECT cik, units, count(*) AS n FROM fx_facts
  WHERE units IN ('USD','EUR','GBP','JPY','CNY','CHF','CAD','AUD') GROUP BY cik, units)
SELECT f.cik, coalesce(c.units, 'USD') AS currency FROM (SELECT DISTINCT cik FROM fx_facts) f
LEFT JOIN (SELECT cik, units, row_number() OVER (PARTITION BY cik ORDER BY n DESC, units) AS rn FROM c) c
  ON f.cik = c.cik AND c.rn = 1
""")
def detect_currency(i):
    return fx.detect_currency(i.fx_facts)


@query("reporting_currency_filter", f"""
WITH f AS (SELECT *, CASE WHEN units = 'shares' OR units = (CASE WHEN cik % 10 = 9 THEN 'EUR' ELSE 'USD' END) THEN 1 ELSE 0 END AS ok FROM fx_facts)
SELECT cik, units, count(*) AS n FROM (SELECT *, max(ok) OVER (PARTITION BY cik) AS any_ok FROM f) g
WHERE ok = 1 OR any_ok = 0 GROUP BY cik, units
""")
def reporting_currency_filter(i):
    money = i.fx_company.select("cik", "currency")
    facts = i.fx_facts.join(money, "cik")
    return fx.currency_filter(facts, F.col("currency")).groupBy("cik", "units").agg(F.count("*").alias("n"))


@query("fiscal_period_filter", f"""
WITH f AS (SELECT *, CASE WHEN fp = 'Q2' AND fy = 1998 AND (start_date IS NULL OR {DUR} BETWEEN 155 AND 205)
   THEN 1 ELSE 0 END AS ok FROM fx_facts)
SELECT {FACT_COLS} FROM (SELECT *, max(ok) OVER (PARTITION BY cik) AS any_ok FROM f) g WHERE ok = 1 OR any_ok = 0
""")
def fiscal_period_filter(i):
    return _cols(fx.fiscal_period_filter(i.fx_facts, "Q2", 1998))


@query("duration_class", f"""
SELECT ptype, count(*) AS n, min(days) AS lo, max(days) AS hi FROM (
  SELECT {DUR} AS days, CASE WHEN start_date IS NULL THEN 'instant' WHEN {DUR} BETWEEN 65 AND 115 THEN 'Q'
    WHEN {DUR} BETWEEN 155 AND 205 THEN 'H' WHEN {DUR} BETWEEN 245 AND 295 THEN '9M'
    WHEN {DUR} BETWEEN 340 AND 400 THEN 'FY' ELSE 'other' END AS ptype
  FROM fx_facts) t GROUP BY ptype
""")
def duration_classes(i):
    df = i.fx_facts.select(
        duration_class().alias("ptype"), F.datediff("end_date", "start_date").alias("days")
    )
    return df.groupBy("ptype").agg(F.count("*").alias("n"), F.min("days").alias("lo"), F.max("days").alias("hi"))


@query("select_period_facts", f"""
SELECT {FACT_COLS} FROM (SELECT *, {NO_DUP} AS rn FROM fx_facts
  WHERE dimension IS NULL AND {DUR} BETWEEN 340 AND 400 AND end_date = date '1999-12-31') d WHERE rn = 1
""")
def select_period_facts(i):
    return _cols(fx.select_period(i.fx_facts.where("dimension IS NULL"), "FY", "1999-12-31"))


@query("taxonomy_fallback", """
SELECT cik, taxonomy, count(*) AS n FROM fx_facts f
WHERE taxonomy = 'us-gaap' OR (SELECT count(*) FROM fx_facts g WHERE g.cik = f.cik AND g.taxonomy = 'us-gaap') <= 900
GROUP BY cik, taxonomy
""")
def taxonomy_fallback(i):
    return fx.taxonomy_fallback(i.fx_facts, enough=900).groupBy("cik", "taxonomy").agg(F.count("*").alias("n"))


@query("concept_history", """
SELECT cik, concept, value, start_date, end_date, filed, form, accn, fy, units FROM fx_facts WHERE concept = 'NetIncomeLoss'
""")
def concept_history(i):
    return fx.concept_history(i.fx_facts, "NetIncomeLoss")


SERIES = "cik, concept, taxonomy, units"


@query("annual_facts", f"""
WITH d AS (SELECT *, {DUR} AS dur FROM {DEDUPED} x),
e AS (SELECT *, max(CASE WHEN dur BETWEEN 340 AND 400 THEN 1 ELSE 0 END) OVER (PARTITION BY {SERIES}) AS has_fy,
  row_number() OVER (PARTITION BY {SERIES}, end_date, dur IS NULL ORDER BY dur DESC, start_date) AS longest FROM d)
SELECT {FACT_COLS} FROM e WHERE dur IS NULL OR (has_fy = 1 AND dur BETWEEN 340 AND 400) OR (has_fy = 0 AND longest = 1)
""")
def annual_facts(i):
    return _cols(fx.annual_facts(fx.dedupe_facts(i.fx_facts.where("dimension IS NULL"))))


@query("ytd_facts", f"""
WITH d AS (SELECT *, {DUR} AS dur FROM {DEDUPED} x),
e AS (SELECT *, max(CASE WHEN dur <= 295 THEN 1 ELSE 0 END) OVER (PARTITION BY {SERIES}) AS has_short FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY {SERIES}, end_date, dur IS NULL ORDER BY dur DESC, start_date) AS longest
  FROM e WHERE dur IS NULL OR dur <= 295 OR has_short = 0)
SELECT {FACT_COLS} FROM g WHERE dur IS NULL OR longest = 1
""")
def ytd_facts(i):
    return _cols(fx.ytd_facts(fx.dedupe_facts(i.fx_facts.where("dimension IS NULL"))))


@query("standalone_quarter_facts", f"""
WITH d AS (SELECT *, {DUR} AS dur FROM {DEDUPED} x),
e AS (SELECT *, max(CASE WHEN dur IS NOT NULL AND fy = 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY cik) AS any_fy FROM d),
g AS (SELECT *, max(CASE WHEN dur IS NOT NULL THEN end_date END) OVER (PARTITION BY cik) AS newest FROM e WHERE dur IS NULL OR fy = 2000 OR any_fy = 0),
h AS (SELECT *, row_number() OVER (PARTITION BY cik, concept, dur IS NULL ORDER BY dur DESC, start_date) AS rn FROM g WHERE dur IS NULL OR end_date = newest)
SELECT {FACT_COLS} FROM h WHERE dur IS NULL OR rn = 1
""")
def standalone_quarter_facts(i):
    # One unit per concept, so that the choice inside a concept is unique.
    facts = fx.dedupe_facts(i.fx_facts.where("dimension IS NULL"))
    return _cols(fx.standalone_quarter_facts(facts, 2000))


@query("duration_fallback_annual", f"""
WITH d AS (SELECT *, {DUR} AS dur FROM {DEDUPED} x),
e AS (SELECT *, max(CASE WHEN dur > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY {SERIES}) AS has_long FROM d)
SELECT {FACT_COLS} FROM e WHERE dur IS NULL OR dur > 300 OR has_long = 0
""")
def duration_fallback_annual(i):
    return _cols(fx.duration_fallback(fx.dedupe_facts(i.fx_facts.where("dimension IS NULL")), "annual"))


@query("duration_fallback", f"""
WITH d AS (SELECT *, {DUR} AS dur FROM {DEDUPED} x),
e AS (SELECT *, max(CASE WHEN dur <= 115 THEN 1 ELSE 0 END) OVER (PARTITION BY {SERIES}) AS has_short,
  row_number() OVER (PARTITION BY {SERIES}, end_date, dur IS NULL ORDER BY dur, start_date DESC NULLS LAST) AS shortest FROM d)
SELECT {FACT_COLS} FROM e WHERE dur IS NULL OR (has_short = 1 AND dur <= 115) OR (has_short = 0 AND shortest = 1)
""")
def duration_fallback(i):
    return _cols(fx.duration_fallback(fx.dedupe_facts(i.fx_facts.where("dimension IS NULL")), "quarterly"))


@query("nth_period", f"""
SELECT {FACT_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY cik, concept ORDER BY end_date DESC NULLS LAST,
  start_date DESC NULLS LAST, filed DESC NULLS LAST, units) AS k FROM {DEDUPED} x) y WHERE k = 3
""")
def nth_period(i):
    return _cols(fx.nth_period(fx.dedupe_facts(i.fx_facts.where("dimension IS NULL")), 2))


@query("periodic_filing_index", """
WITH s AS (SELECT *, CASE WHEN taxonomy <> 'dei' THEN 1 ELSE 0 END AS ok FROM fx_facts),
t AS (SELECT *, max(ok) OVER (PARTITION BY cik, form) AS any_ok FROM s),
u AS (SELECT *, CASE WHEN end_date <= filed THEN 1 ELSE 0 END AS ok2 FROM t WHERE ok = 1 OR any_ok = 0),
v AS (SELECT *, max(ok2) OVER (PARTITION BY cik, form) AS any2 FROM u)
SELECT cik, form, accn, max(end_date) AS report_date, min(filed) AS filed FROM v WHERE ok2 = 1 OR any2 = 0 GROUP BY cik, form, accn
""")
def periodic_filing_index(i):
    return fx.periodic_filing_index(i.fx_facts)


@query("dominant_period", """
WITH p AS (SELECT cik, accn, fp, row_number() OVER (PARTITION BY cik, accn ORDER BY count(*) DESC, fp) AS rn FROM fx_facts GROUP BY cik, accn, fp),
y AS (SELECT cik, accn, fy, row_number() OVER (PARTITION BY cik, accn ORDER BY count(*) DESC, fy) AS rn FROM fx_facts GROUP BY cik, accn, fy)
SELECT p.cik, p.accn, p.fp, y.fy FROM p JOIN y ON p.cik = y.cik AND p.accn = y.accn WHERE p.rn = 1 AND y.rn = 1
""")
def dominant_period(i):
    return fx.dominant_period(i.fx_facts)


STATEMENT = ("Revenues", "CostOfRevenue", "OperatingIncomeLoss", "NetIncomeLoss")


@query("raw_statement", f"""
WITH a AS (SELECT *, {DUR} AS dur FROM {DEDUPED} x WHERE {DUR} BETWEEN 340 AND 400 AND units = CASE WHEN cik % 10 = 9 THEN 'EUR' ELSE 'USD' END),
r AS (SELECT *, row_number() OVER (PARTITION BY cik, concept ORDER BY end_date DESC NULLS LAST, filed DESC NULLS LAST, start_date DESC NULLS LAST, units) AS k
  FROM a WHERE concept IN ('Revenues', 'CostOfRevenue', 'OperatingIncomeLoss', 'NetIncomeLoss'))
SELECT cik, concept, CASE concept WHEN 'Revenues' THEN 0 WHEN 'CostOfRevenue' THEN 1 WHEN 'OperatingIncomeLoss' THEN 2 ELSE 3 END AS line_no,
  max(CASE WHEN k = 1 THEN label END) AS label, max(CASE WHEN k = 1 THEN value END) AS value,
  max(CASE WHEN k = 2 THEN value END) AS prior_value, max(CASE WHEN k = 1 THEN end_date END) AS end_date
FROM r GROUP BY cik, concept
""")
def raw_statement(i):
    facts = fx.dedupe_facts(i.fx_facts.where("dimension IS NULL"))
    facts = fx.with_period(facts).where("ptype = 'FY' AND units = CASE WHEN cik % 10 = 9 THEN 'EUR' ELSE 'USD' END")
    return fx.statement_lines(facts, STATEMENT)
