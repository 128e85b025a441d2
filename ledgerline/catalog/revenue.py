"""Revenue breakdowns by dimension, tag name and filing table."""

import re

from pyspark.sql import functions as F

from ledgerline.catalog.registry import query
from ledgerline.functions.labels import clean_segment_label
from ledgerline.operators import facts as fx
from ledgerline.operators import segments as sg

MEMBER = "value > 0 AND NOT regexp_matches(lower(label), 'total|elimination|consolidat|reconcil|intersegment|corporate and other unallocated')"
GEN = "lower(trim(label)) IN ('product', 'products', 'service', 'services', 'service and other', 'services and other', 'product and other', 'products and services')"
MAXED = f"m AS (SELECT cik, fy, axis, label, max(value) AS value FROM fx_segments WHERE {MEMBER} GROUP BY cik, fy, axis, label)"

# Removal is sequential, so the twin steps through each group with a recursion.
SUBTOTALS = f"""{MAXED},
g AS (SELECT cik, fy, axis, list(value ORDER BY value DESC, label) AS vals, list(label ORDER BY value DESC, label) AS labs FROM m GROUP BY cik, fy, axis),
walk AS (SELECT cik, fy, axis, vals, labs, 1 AS i FROM g
  UNION ALL SELECT cik, fy, axis,
    CASE WHEN hit THEN list_concat(vals[:i - 1], vals[i + 1:]) ELSE vals END, CASE WHEN hit THEN list_concat(labs[:i - 1], labs[i + 1:]) ELSE labs END, CASE WHEN hit THEN i ELSE i + 1 END
  FROM (SELECT *, len(vals) <= 11 AND len(list_filter(range(1, (1 << (len(vals) - 1)::int)::bigint), lambda k: bit_count(k::bigint) >= 2 AND
      abs(list_sum(list_transform(range(0, len(vals) - 1), lambda j: CASE WHEN (k >> j::int) & 1 = 1 THEN list_concat(vals[:i - 1], vals[i + 1:])[j + 1] ELSE 0 END)) - vals[i]) / vals[i] < 0.001)) > 0 AS hit
    FROM walk WHERE i <= len(vals) AND len(vals) > 2 AND len(vals) <= 11) s),
last AS (SELECT cik, fy, axis, arg_max(labs, i * 100 - len(labs)) AS labs FROM walk GROUP BY cik, fy, axis),
d AS (SELECT m.* FROM m JOIN last USING (cik, fy, axis) WHERE list_contains(labs, label))"""


@query("segment_members", f"SELECT cik, fy, axis, label, value FROM fx_segments WHERE {MEMBER}")
def segment_members(i):
    return sg.segment_members(i.fx_segments)


@query("drop_subtotals", f"WITH RECURSIVE {SUBTOTALS} SELECT cik, fy, axis, label, value FROM d")
def drop_subtotals(i):
    return sg.drop_subtotals(sg.segment_members(i.fx_segments))


@query("drop_generic_partition", f"""
WITH {MAXED}, s AS (SELECT *, sum(CASE WHEN {GEN} THEN cast(value AS decimal(28,4)) END) OVER w AS gs, sum(CASE WHEN NOT {GEN} THEN cast(value AS decimal(28,4)) END) OVER w AS ds, count(CASE WHEN NOT {GEN} THEN 1 END) OVER w AS n
 FROM m WHERE label <> 'Heavy Goods' OR cik % 2 = 0 WINDOW w AS (PARTITION BY cik, fy, axis))
SELECT cik, fy, axis, label, value FROM s WHERE NOT ({GEN} AND n >= 2 AND gs <> 0 AND coalesce(abs(gs::double - ds::double) / gs::double < 0.02, false))
""")
def drop_generic_partition(i):
    members = sg.segment_members(i.fx_segments).where("label <> 'Heavy Goods' OR cik % 2 = 0")
    return sg.drop_generic_partition(members)


@query("drop_parent_rows", f"""
WITH {MAXED}, s AS (SELECT *, sum(cast(value AS decimal(28,4))) OVER w AS t, count(*) OVER w AS n FROM m WHERE axis = 'ProductOrServiceAxis' WINDOW w AS (PARTITION BY cik, fy, axis))
SELECT cik, fy, axis, label, value FROM s WHERE NOT (n > 2 AND abs(value - (t::double - value)) / t::double < 0.05)
""")
def drop_parent_rows(i):
    members = sg.segment_members(i.fx_segments).where("axis = 'ProductOrServiceAxis'")
    return sg.drop_parents(members, sg.GROUP)


@query("axis_breakdown", f"""
WITH RECURSIVE {SUBTOTALS}, s AS (SELECT *, sum(CASE WHEN {GEN} THEN cast(value AS decimal(28,4)) END) OVER w AS gs, sum(CASE WHEN NOT {GEN} THEN cast(value AS decimal(28,4)) END) OVER w AS ds, count(CASE WHEN NOT {GEN} THEN 1 END) OVER w AS n
 FROM d WINDOW w AS (PARTITION BY cik, fy, axis)),
k AS (SELECT cik, fy, axis, label, value FROM s WHERE NOT ({GEN} AND n >= 2 AND gs <> 0 AND coalesce(abs(gs::double - ds::double) / gs::double < 0.02, false))),
t AS (SELECT *, sum(cast(value AS decimal(28,4))) OVER w AS total, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY cik, fy, axis))
SELECT cik, fy, axis, label, value, value / total::double * 100 AS pct FROM t WHERE n >= 2
""")
def axis_breakdown(i):
    return sg.axis_breakdown(i.fx_segments)


@query("geographic_labels", """
SELECT cik, fy, axis, count(CASE WHEN regexp_matches(lower(label), 'americas|europe|china|japan|asia|united states|international|emea|apac|canada|rest of|domestic|foreign|other countries|latin america|middle east') THEN 1 END)
  >= greatest(2, floor(count(*) / 2.0)) AS geographic FROM fx_dims GROUP BY cik, fy, axis
""")
def geographic_labels(i):
    return sg.looks_geographic(i.fx_dims)


@query("segment_source_priority", """
WITH a AS (SELECT cik, fy, label, value, 'dimensions' AS source, 0 AS p FROM fx_dims WHERE axis = 'StatementGeographicalAxis' AND cik % 3 = 0),
b AS (SELECT cik, fy, label, value, 'concepts', 1 FROM fx_dims WHERE axis = 'ProductOrServiceAxis' AND (cik % 2 = 0 OR label = 'PROMO')),
c AS (SELECT cik, fy, metric, value, 'vendor', 2 FROM fx_vendor),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
k AS (SELECT cik, fy, p FROM u GROUP BY cik, fy, p HAVING count(*) >= 2), m AS (SELECT cik, fy, min(p) AS p FROM k GROUP BY cik, fy)
SELECT u.cik, u.fy, label, value, source FROM u JOIN m ON u.cik = m.cik AND u.fy = m.fy AND u.p = m.p
""")
def segment_source_priority(i):
    dims = i.fx_dims
    a = dims.where("axis = 'StatementGeographicalAxis' AND cik % 3 = 0").withColumn("source", F.lit("dimensions"))
    b = dims.where("axis = 'ProductOrServiceAxis' AND (cik % 2 = 0 OR label = 'PROMO')").withColumn("source", F.lit("concepts"))
    c = i.fx_vendor.withColumnRenamed("metric", "label").withColumn("source", F.lit("vendor"))
    return sg.segment_sources([a, b, c], ["cik", "fy"])


@query("clean_segment_labels", """
SELECT DISTINCT concept, CASE concept WHEN 'OnlineStoresRevenue' THEN 'Online Stores' WHEN 'UnitedStatesRevenue' THEN 'United States' WHEN 'EuropeSegmentRevenue' THEN 'Europe Segment' WHEN 'SubscriptionRevenue' THEN 'Subscription' WHEN 'Revenues' THEN 'Revenues' WHEN 'NoninterestIncome' THEN 'Noninterest Income' END AS label
FROM fx_facts WHERE concept IN ('OnlineStoresRevenue', 'UnitedStatesRevenue', 'EuropeSegmentRevenue', 'SubscriptionRevenue', 'Revenues', 'NoninterestIncome')
""")
def clean_segment_labels(i):
    names = ("OnlineStoresRevenue", "UnitedStatesRevenue", "EuropeSegmentRevenue", "SubscriptionRevenue", "Revenues", "NoninterestIncome")
    return i.fx_facts.where(F.col("concept").isin(*names)).select("concept").distinct().withColumn("label", clean_segment_label("concept"))


@query("concept_segments", """
WITH f AS (SELECT cik, end_date, CASE concept WHEN 'UnitedStatesRevenue' THEN 'geographic' WHEN 'EuropeSegmentRevenue' THEN 'geographic' ELSE 'product' END AS axis,
  CASE concept WHEN 'UnitedStatesRevenue' THEN 'United States' WHEN 'EuropeSegmentRevenue' THEN 'Europe' WHEN 'OnlineStoresRevenue' THEN 'Online Stores' WHEN 'InvestmentBankingRevenue' THEN 'Investment Banking' ELSE 'Subscription' END AS label, value
  FROM fx_facts WHERE form = '10-K' AND concept IN ('UnitedStatesRevenue', 'EuropeSegmentRevenue', 'OnlineStoresRevenue', 'SubscriptionRevenue', 'InvestmentBankingRevenue')),
m AS (SELECT cik, end_date, axis, label, max(value) AS value FROM f WHERE value > 0 GROUP BY 1, 2, 3, 4)
SELECT *, value / (sum(cast(value AS decimal(28,4))) OVER (PARTITION BY cik, end_date, axis))::double * 100 AS pct FROM m
""")
def concept_segments(i):
    return sg.concept_segments(fx.form_filter(i.fx_facts, ["10-K"]))


# The region names in turn, five to a filing. A line in which two patterns match is read as a row of headings,
# so only names of one pattern serve here.
_MATCHING = {name: [label for pattern, label in sg.GEO_TEXT if re.search(pattern, name)] for name in dict.fromkeys(label for _, label in sg.GEO_TEXT)}
REGION_NAMES = tuple(n for n, m in _MATCHING.items() if m == [n])


def _geo_rows(names):
    return f"""SELECT cik, fy, list_element([{", ".join(map(_text, names))}], ((cik * 5 + r) % {len(names)} + 1)::int) AS name, cast(value AS decimal(18,0)) AS value
  FROM (SELECT *, CASE label WHEN 'AFRICA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 3 ELSE 4 END AS r FROM fx_dims
    WHERE axis = 'StatementGeographicalAxis' AND label IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')) x"""


def _text(name):
    return "'" + name.replace("'", "''") + "'"


def _geo_sql(names, values):
    within = " OR ".join(f"(label = '{a}' AND list_contains(have, '{b}'))" for a, b in sg.SUBSETS)
    return f"""
WITH d AS ({_geo_rows(names)}),
v AS (SELECT cik, fy, name AS label, max(value)::double * 1000 AS value FROM d WHERE {values} GROUP BY ALL),
h AS (SELECT *, list(label) OVER (PARTITION BY cik, fy) AS have FROM v)
SELECT cik, fy, label, value, value / (sum(cast(value AS decimal(28,4))) OVER (PARTITION BY cik, fy))::double * 100 AS pct FROM h WHERE NOT ({within})
"""


def _geo_text(i, names, columnar=False):
    """Filing text with a regional revenue table, written from the data."""
    place = {"AFRICA": 0, "AMERICA": 1, "ASIA": 2, "EUROPE": 3, "MIDDLE EAST": 4}
    d = i.fx_dims.where(F.col("label").isin(*place) & (F.col("axis") == "StatementGeographicalAxis"))
    r = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])[F.col("label")]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), ((F.col("cik") * 5 + r) % len(names) + 1).cast("int"))
    amount = F.format_number(F.col("value").cast("decimal(18,0)"), 0)
    rows = F.array_sort(F.collect_list(F.struct(r.alias("r"), name.alias("label"), amount.alias("a"))))
    g = d.groupBy("cik", "fy").agg(rows.alias("r"))
    filler = F.repeat(F.lit("The company sells goods in many markets and reports results each year. "), 4)
    if columnar:
        head = F.array_join(F.transform("r", lambda x: x["label"]), "  |  ")
        vals = F.array_join(F.transform("r", lambda x: F.concat(F.lit("$ "), x["a"])), "   ")
        body = F.concat(head, F.lit("\nNet sales "), vals)
    else:
        body = F.array_join(F.transform("r", lambda x: F.concat(x["label"], F.lit("     $"), x["a"], F.lit("   $1,000"))), "\n")
    heading = F.when(F.col("cik") % 2 == 0, "Revenue by geography").otherwise("Revenue earned in customer by geography")
    text = F.concat(filler, F.lit("\n"), heading, F.lit(" (in thousands)\n"), body, F.lit("\nTotal  $9,999,999\n"), filler)
    return g.select("cik", "fy", text.alias("text"))


@query("geographic_table_rows", _geo_sql(REGION_NAMES, "value > 0 AND value NOT BETWEEN 1900 AND 2100"))
def geographic_table_rows(i):
    return sg.geographic_table(_geo_text(i, REGION_NAMES), key=("cik", "fy"))


@query("geographic_table_columns", _geo_sql(REGION_NAMES, "value > 0"))
def geographic_table_columns(i):
    return sg.geographic_table(_geo_text(i, REGION_NAMES, columnar=True), key=("cik", "fy"))


BUSINESSES = """
WITH d AS (SELECT cik, fy, 'Line ' || translate(label, '0123456789#', 'ABCDEFGHIJN') AS label, cast(value AS decimal(18,0))::double AS value FROM fx_dims WHERE axis IN ('ProductOrServiceAxis', 'StatementBusinessSegmentsAxis') AND value >= 2101),
m AS (SELECT cik, fy, label, max(value) AS value FROM d GROUP BY ALL),
s AS (SELECT *, (sum(cast(value AS decimal(28,4))) OVER (PARTITION BY cik, fy))::double AS t, count(*) OVER (PARTITION BY cik, fy) AS c FROM m),
k AS (SELECT cik, fy, label, value * 1000 AS value FROM s WHERE NOT (c > 2 AND abs(value - (t - value)) / t < 0.05)),
p AS (SELECT *, value / (sum(cast(value AS decimal(28,4))) OVER (PARTITION BY cik, fy))::double * 100 AS pct, count(*) OVER (PARTITION BY cik, fy) AS n FROM k)
SELECT cik, fy, label, value, pct FROM p WHERE n >= 2 AND pct >= 0.95
"""


@query("segment_sections_revenue", BUSINESSES)
def segment_sections_revenue(i):
    """Texts without any heading of a segment table: each business has a section and a line with its revenue."""
    d = i.fx_dims.where("axis IN ('ProductOrServiceAxis', 'StatementBusinessSegmentsAxis') AND value >= 2101")
    name = F.concat(F.lit("Line "), F.translate("label", "0123456789#", "ABCDEFGHIJN"))
    section = F.concat(name, F.lit("\nStatement of Income (unaudited)\nOther costs 17\nNet revenues  $ "), F.format_number(F.col("value").cast("decimal(18,0)"), 0), F.lit("  1,000\n"))
    g = d.groupBy("cik", "fy").agg(F.array_join(F.array_sort(F.collect_list(section)), "\n").alias("body"))
    filler = F.repeat(F.lit("Our lines share plants and people. "), 4)
    text = F.concat(filler, F.lit("\nAmounts (in thousands)\n"), "body", F.lit("\n"), filler)
    return sg.segment_table(g.select("cik", "fy", text.alias("text")), key=("cik", "fy"))


@query("segment_table", """
WITH d AS (SELECT cik, fy, 'Line ' || label AS label, cast(value AS decimal(18,0))::double AS value FROM fx_dims WHERE axis = 'ProductOrServiceAxis'),
s AS (SELECT *, (sum(cast(value AS decimal(28,4))) OVER (PARTITION BY cik, fy))::double AS t FROM d),
k AS (SELECT cik, fy, label, value * 1000000 AS value FROM s WHERE NOT (abs(value - (t - value)) / t < 0.05)),
p AS (SELECT *, value / (sum(cast(value AS decimal(28,4))) OVER (PARTITION BY cik, fy))::double * 100 AS pct, count(*) OVER (PARTITION BY cik, fy) AS n FROM k)
SELECT cik, fy, label, value, pct FROM p WHERE n >= 2 AND pct >= 0.95
""")
def segment_table(i):
    d = i.fx_dims.where("axis = 'ProductOrServiceAxis'")
    line = F.concat(F.lit("Line "), "label", F.lit(" ..... $"), F.format_number(F.col("value").cast("decimal(18,0)"), 0))
    g = d.groupBy("cik", "fy").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    filler = F.repeat(F.lit("Our business is organised in lines that share plants and people. "), 4)
    text = F.concat(filler, F.lit("\nRevenue by segment (in millions)\n"), "body", F.lit("\nTotal $1\n"))
    return sg.segment_table(g.select("cik", "fy", text.alias("text")), key=("cik", "fy"))
