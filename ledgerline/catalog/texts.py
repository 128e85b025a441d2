"""Filing text, conversations and statement trees."""

from pyspark.sql import functions as F

from ledgerline.catalog.registry import query
from ledgerline.operators import facts as fx
from ledgerline.operators import graph as gr
from ledgerline.operators import sections as se
from ledgerline.operators import text as tx


@query("phrase_search", """
WITH b AS (SELECT item_id, unnest(string_split(text, '. ')) AS phrase, unnest(range(0, len(string_split(text, '. ')))) AS pos FROM benchmark)
SELECT DISTINCT d.doc_id, b.item_id * 10000 + pos AS phrase_id FROM documents d JOIN b ON trim(phrase, chr(10) || chr(9) || chr(13) || ' ') <> '' AND contains(lower(d.text), lower(phrase))
""")
def phrase_search(i):
    # Every sentence of every benchmark item, whole.
    s = i.benchmark.select("item_id", F.posexplode(F.split("text", "[.] ")).alias("pos", "phrase"))
    phrases = s.select((F.col("item_id") * 10000 + F.col("pos")).alias("phrase_id"), "phrase")
    return tx.phrase_search(i.documents, phrases, phrase_id="phrase_id")


@query("diff_sections", r"""
WITH p AS (SELECT a.doc_id, a.text AS t1, b.text AS t2 FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
x AS (SELECT doc_id, unnest(string_split(t1, chr(10))) AS para, unnest(range(0, len(string_split(t1, chr(10))))) AS pos FROM p),
y AS (SELECT doc_id, unnest(string_split(t2, chr(10))) AS para, unnest(range(0, len(string_split(t2, chr(10))))) AS pos FROM p),
kx AS (SELECT doc_id, lower(trim(regexp_replace(para, '\s+', ' ', 'g'))) AS k, arg_max(para, pos) AS para, min(pos) AS pos FROM x WHERE trim(regexp_replace(para, '\s+', ' ', 'g')) <> '' GROUP BY 1, 2),
ky AS (SELECT doc_id, lower(trim(regexp_replace(para, '\s+', ' ', 'g'))) AS k, arg_max(para, pos) AS para, min(pos) AS pos FROM y WHERE trim(regexp_replace(para, '\s+', ' ', 'g')) <> '' GROUP BY 1, 2),
a AS (SELECT doc_id, count(*) AS n, string_agg(para, chr(10) || chr(10) ORDER BY pos) AS t FROM ky WHERE NOT EXISTS (SELECT 1 FROM kx WHERE kx.doc_id = ky.doc_id AND kx.k = ky.k) GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n, string_agg(para, chr(10) || chr(10) ORDER BY pos) AS t FROM kx WHERE NOT EXISTS (SELECT 1 FROM ky WHERE kx.doc_id = ky.doc_id AND kx.k = ky.k) GROUP BY doc_id)
SELECT p.doc_id, coalesce(a.n, 0)::int AS n_added, coalesce(r.n, 0)::int AS n_removed, (length(t2) - length(t1))::int AS length_change, md5(coalesce(a.t, '')) AS added_md5,
 md5(coalesce(r.t, '')) AS removed_md5 FROM p LEFT JOIN a ON p.doc_id = a.doc_id LEFT JOIN r ON p.doc_id = r.doc_id
""")
def diff_sections(i):
    # Every document against the one after it; the data has no blank lines.
    old = i.documents.select("doc_id", "text")
    new = i.documents.select((F.col("doc_id") - 1).alias("doc_id"), "text")
    out = tx.diff_sections(old, new, ["doc_id"], "\n")
    return out.select("doc_id", "n_added", "n_removed", "length_change", F.md5(F.coalesce("added_text", F.lit(""))).alias("added_md5"),
                      F.md5(F.coalesce("removed_text", F.lit(""))).alias("removed_md5"))


@query("proxy_fallback", """
WITH s AS (SELECT doc_id, source, 'See the Proxy Statement. ' || text AS text FROM documents), n AS (SELECT source, arg_max(text, doc_id) AS pt, max(doc_id) AS newest FROM documents GROUP BY source)
SELECT doc_id, length(s.text) < 3000 AND length(pt) > length(s.text) AS from_proxy, md5(CASE WHEN length(s.text) < 3000 AND length(pt) > length(s.text) THEN '[From the proxy statement filed ' || newest || ']' || chr(10) || chr(10) || pt ELSE s.text END) AS text_md5
FROM s JOIN n ON s.source = n.source
""")
def proxy_fallback(i):
    d = i.documents
    sections = d.select("doc_id", "source", F.concat(F.lit("See the Proxy Statement. "), "text").alias("text"))
    proxies = d.select("source", F.col("doc_id").alias("filed"), F.col("text").alias("proxy_text"))
    out = tx.proxy_fallback(sections, proxies, key="source")
    return out.select("doc_id", "from_proxy", F.md5("text").alias("text_md5"))


@query("chunk_text", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w, text FROM documents),
c AS (SELECT doc_id, w, text, len(w) AS n, unnest(range(0, greatest(ceil((len(w) - 64) / 48.0), 0)::bigint + 1)) AS k FROM w WHERE len(w) > 0)
SELECT doc_id, k::int AS chunk_no, md5(CASE WHEN n <= 64 THEN text ELSE array_to_string(w[k * 48 + 1:k * 48 + 64], ' ') END) AS chunk_md5 FROM c
""")
def chunk_text(i):
    return tx.chunk_text(i.documents, 64, 16).select("doc_id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


@query("text_entities", r"""
WITH d AS (SELECT doc_id, text || ' On March ' || (doc_id % 28 + 1) || ', 2021 sales rose ' || (doc_id % 90) || '.5% to $' || (doc_id + 1) || ',000 million in FY2020 and Q' || (doc_id % 4 + 1) || ' 2021' AS text FROM documents)
SELECT doc_id, 'MONEY' AS label, trim(e) AS entity, 1.0::double AS score FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\$[\d,]+(?:\.\d+)?(?:\s*(?:million|billion|thousand|mn|bn|k))?')) AS e FROM d)
UNION ALL SELECT doc_id, 'PERCENT', trim(e), 1.0 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\d+\.?\d*\s*%')) AS e FROM d)
UNION ALL SELECT doc_id, 'DATE', trim(e), 1.0 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:Q[1-4]\s*\d{4}|fiscal\s+year\s+\d{4}|FY\s*\d{2,4}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})')) AS e FROM d)
""")
def text_entities(i):
    return tx.entities(_with_figures(i))


def _with_figures(i):
    """Documents with a closing sentence of figures, which the prose lacks."""
    d = F.col("doc_id")
    s = lambda c: c.cast("string")
    tail = F.concat(
        F.lit(" On March "), s(d % 28 + 1), F.lit(", 2021 sales rose "), s(d % 90), F.lit(".5% to $"), s(d + 1),
        F.lit(",000 million in FY2020 and Q"), s(d % 4 + 1), F.lit(" 2021"),
    )
    return i.documents.select("doc_id", F.concat("text", tail).alias("text"))


@query("entity_counts", r"""
WITH d AS (SELECT doc_id, text || ' ' || (doc_id % 90) || '.5% and ' || (doc_id % 90) || '.5% or ' || (doc_id % 7) || ' %' AS text FROM documents),
e AS (SELECT doc_id, 'PERCENT' AS label, trim(e) AS entity FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\d+\.?\d*\s*%')) AS e FROM d)
UNION ALL SELECT doc_id, 'MONEY', trim(e) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\$[\d,]+(?:\.\d+)?(?:\s*(?:million|billion|thousand|mn|bn|k))?')) AS e FROM d)
UNION ALL SELECT doc_id, 'DATE', trim(e) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:Q[1-4]\s*\d{4}|fiscal\s+year\s+\d{4}|FY\s*\d{2,4}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})')) AS e FROM d))
SELECT doc_id, label, count(DISTINCT entity) AS n FROM e GROUP BY doc_id, label
""")
def entity_counts(i):
    d = F.col("doc_id")
    half = (d % 90).cast("string")
    text = F.concat("text", F.lit(" "), half, F.lit(".5% and "), half, F.lit(".5% or "), (d % 7).cast("string"), F.lit(" %"))
    return tx.entity_counts(tx.entities(i.documents.select("doc_id", text.alias("text"))))


@query("weighted_labels", """
WITH s AS (SELECT source, sum(cast(quality * weight AS decimal(28,6)))::double / sum(weight) AS quality, sum(cast(toxic * weight AS decimal(28,6)))::double / sum(weight) AS toxic FROM fx_chunks GROUP BY source)
SELECT *, CASE WHEN quality >= toxic THEN 'quality' ELSE 'toxic' END AS label, greatest(quality, toxic) AS score FROM s
""")
def weighted_labels(i):
    return tx.weighted_labels(i.fx_chunks, ["quality", "toxic"], key=("source",))


@query("last_turns", """
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) t WHERE rn <= 6 AND role IN ('user', 'assistant') AND trim(coalesce(text, ''), chr(10) || chr(9) || ' ') <> ''
""")
def last_turns(i):
    return tx.last_turns(i.conversations).select("conv_id", "turn", "role")


@query("html_to_text")
def html_to_text(i):
    t = tx.html_to_text("html")
    return i.pages.select("page_id", t.alias("text")).select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("page_titles", r"""
SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')) AS heading FROM pages WHERE regexp_matches(html, '(?i)<h1[^>]*>[^<&]+</h1>')
""")
def page_titles(i):
    # The heading must survive as a line of its own.
    head = F.trim(F.regexp_extract("html", "(?is)<h1[^>]*>([^<&]+)</h1>", 1))
    p = i.pages.where(F.col("html").rlike("(?i)<h1[^>]*>[^<&]+</h1>")).select("page_id", tx.html_to_text("html").alias("text"), head.alias("h"))
    lines = F.split("text", "\n")
    want = F.regexp_replace("h", "[ \t]+", " ")
    return p.select("page_id", F.when(F.array_contains(lines, want), F.col("h")).alias("heading"))


@query("anchored_sections")
def anchored_sections(i):
    tagged = F.concat(F.lit("<p>Item 7. Contents</p><a id='item_7'></a>"), "html", F.lit("<p>Item 8. Next</p><p>tail</p>"))
    s = i.pages.select("page_id", tx.anchored_section(tagged, "7").alias("text"))
    return s.select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("clean_filing_text", r"""
WITH t AS (SELECT doc_id, replace(text, chr(10), ' ' || chr(10) || chr(10) || chr(10) || chr(10)) || '&nbsp;&amp;' || chr(160) || '     x' AS text FROM documents)
SELECT doc_id, md5(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '&nbsp;', ' '), '&amp;', '&'), '&#160;', ' '), chr(160), ' '), ' {3,}', '  ', 'g')) AS text_md5 FROM t
""")
def clean_filing_text(i):
    raw = F.concat(F.replace("text", F.lit("\n"), F.lit(" \n\n\n\n")), F.lit("&nbsp;&amp;      x"))
    return i.documents.select("doc_id", F.md5(tx.clean_text(raw)).alias("text_md5"))


@query("signature_blocks", r"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Power of Attorney ' || text WHEN doc_id % 3 = 1 THEN text || ' /s/ Ann /s/ Bob /s/ Cy' ELSE text END AS text FROM documents)
SELECT doc_id, length(trim(text)) >= 100 AND (contains(lower(text), 'power of attorney') OR len(regexp_extract_all(text, '/s/\s*[A-Z][a-z]+')) >= 3) AS signature FROM t
""")
def signature_blocks(i):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Power of Attorney "), "text")).when(
        F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" /s/ Ann /s/ Bob /s/ Cy"))).otherwise(F.col("text"))
    return i.documents.select("doc_id", tx.is_signature_block(t).alias("signature"))


@query("filing_signatures", r"""
WITH s AS (SELECT doc_id, k, unnest([0, 1, 2]) AS j FROM (SELECT doc_id, (doc_id % 4)::int AS k FROM documents) x)
SELECT doc_id, CASE j WHEN 0 THEN 'Ann B. Smith' WHEN 1 THEN 'Carl O''Neill-Fox' ELSE 'Dora Young' END AS signer,
  CASE WHEN j = 0 THEN 'Chief Executive Officer' WHEN j = 1 AND k >= 2 THEN 'Director and Treasurer' END AS title FROM s WHERE j < k
""")
def filing_signatures(i):
    """Signature pages behind every document: up to three names, titles on the next lines or missing."""
    pages = (
        "/s/ Ann B. Smith\nAnn B. Smith\nChief Executive Officer", "\n/s/  Carl O'Neill-Fox\n\nDirector and Treasurer", "\n/s/ Dora Young\nMay 5, 2024\n/s/ nobody",
    )
    k = F.col("doc_id") % 4
    signed = F.concat(*[F.when(k > j, F.lit(page)).otherwise("") for j, page in enumerate(pages)])
    return tx.signed_by(i.documents.select("doc_id", F.concat("text", F.lit("\nSIGNATURES\n"), signed).alias("text")))


@query("event_items", r"""
SELECT doc_id, md5(trim(text, chr(10) || chr(9) || ' ')) AS body_md5, '2.02,9.01' AS items FROM documents WHERE NOT regexp_matches(text, '(?i)signature|item\s*\d+\.\d+')
""")
def event_items(i):
    d = i.documents.where(~F.col("text").rlike(r"(?i)signature|item\s*\d+\.\d+"))
    report = F.concat(F.lit("Item 1.01 Other. Item 2.02. "), "text", F.lit("\nItem 9.01 Exhibits"))
    listed = F.array_join(tx.listed_items(F.lit("Item 2.02, Item 9.01")), ",")
    return d.select("doc_id", F.md5(tx.event_item(report, "item_2.02")).alias("body_md5"), listed.alias("items"))


def _reports(i, titles_only=False):
    """Annual reports written around the documents: a contents list, then three sections."""
    toc = ["1. Business", "1A. Risk Factors", "2. Properties", "3. Legal Proceedings", "7. Management's Discussion", "8. Financial Statements and Supplementary Data"]
    pad = F.repeat(F.lit("filler line\n"), 60)
    name = (lambda t: t.split(". ", 1)[1].upper()) if titles_only else (lambda t: f"Item {t}")
    # A column of its own: it stands in every section and is made once.
    docs = i.documents.select("doc_id", F.regexp_replace("text", "(?i)business|risk factor|propert|cybersec|reserved|item", "word").alias("body"))
    body = F.col("body")
    # Long lines of plain words, so that a section has substance below its header.
    long = F.lit("\n" + "plain words that fill the section with content and nothing else at all " * 3 + "\n")
    head = F.concat(body, F.lit("\n")) if titles_only else F.lit("\n".join(f"Item {t} {n}" for n, t in enumerate(toc, 3)) + "\n")
    parts = [head, pad]
    for t in toc:
        parts += [F.lit(name(t)), long, body, F.lit("\n"), pad]
    parts += [F.lit("Power of Attorney\nsigned")]
    return docs.select("doc_id", F.concat(*parts).alias("text"))


SECTION_SQL = """
WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), k(item, k) AS (VALUES ('1', 0), ('1A', 1), ('2', 2), ('3', 3), ('7', 4), ('8', 5))
SELECT doc_id, item, ({toc} + 60 + k * (62 + n))::int AS start_line, ({toc} + 60 + (k + 1) * (62 + n))::int AS end_line FROM d, k
"""


@query("segment_sections", SECTION_SQL.format(toc=6))
def segment_sections(i):
    return se.segment(_reports(i))


@query("segment_by_titles", SECTION_SQL.format(toc="n"))
def segment_by_titles(i):
    return se.segment(_reports(i, titles_only=True))


@query("section_text", """
WITH d AS (SELECT doc_id, regexp_replace(text, '(?i)business|risk factor|propert|cybersec|reserved|item', 'word', 'g') AS text FROM documents)
SELECT doc_id, md5('Item 1A. Risk Factors' || chr(10) || repeat('plain words that fill the section with content and nothing else at all ', 3) || chr(10) || text || chr(10) || rtrim(repeat('filler line' || chr(10), 60), chr(10))) AS text_md5 FROM d
""")
def section_text(i):
    docs = _reports(i)
    found = se.section_text(docs, se.segment(docs).where("item = '1A'"))
    return found.select("doc_id", F.md5("text").alias("text_md5"))


@query("named_sections", """
WITH d AS (SELECT doc_id, regexp_replace(text, '(?i)business|risk factor|propert|cybersec|reserved|item', 'word', 'g') AS text FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'risk_factors' ELSE ' Risk_Factors ' END AS name, '1A' AS item,
 md5('Item 1A. Risk Factors' || chr(10) || repeat('plain words that fill the section with content and nothing else at all ', 3) || chr(10) || text || chr(10) || rtrim(repeat('filler line' || chr(10), 60), chr(10))) AS text_md5 FROM d WHERE doc_id % 3 < 2
""")
def named_sections(i):
    """Two spellings of one section and an unknown name, over all documents."""
    docs = _reports(i)
    name = F.when(F.col("doc_id") % 3 == 0, "risk_factors").when(F.col("doc_id") % 3 == 1, " Risk_Factors ").otherwise("no such section")
    found = se.named_sections(docs, se.segment(docs), docs.select("doc_id", name.alias("name")))
    return found.select("doc_id", "name", "item", F.md5("text").alias("text_md5"))


@query("stub_redirect")
def stub_redirect(i):
    """Sections that only point elsewhere take the text of the real heading."""
    stub = F.lit("Item 7. Management's Discussion\nThe discussion is on pages 5 to 20, incorporated by reference.\nItem 8. Financial Statements and Supplementary Data\nbody\n")
    text = F.concat(F.lit("MANAGEMENT'S DISCUSSION\n"), "text", F.lit("\n"), F.repeat(F.lit("a line of real content below the heading\n"), 40), stub)
    docs = i.documents.select("doc_id", text.alias("text"))
    out = se.section_text(docs, se.segment(docs).where("item = '7'"))
    return out.select("doc_id", "is_stub", F.length("text").alias("n_chars"))


EDGE_WALK = """
WITH RECURSIVE p AS (SELECT statement, child, arg_max(parent, ord) AS parent FROM fx_edges GROUP BY statement, child),
w AS (SELECT statement, child, child AS at, 0 AS depth, []::varchar[] AS seen FROM p
  UNION ALL SELECT w.statement, w.child, p.parent, w.depth + 1, list_append(w.seen, w.at) FROM w JOIN p ON p.statement = w.statement AND p.child = w.at WHERE NOT list_contains(w.seen, w.at))
SELECT statement, child, max(depth)::int AS depth FROM w GROUP BY statement, child
"""


@query("concept_depths", EDGE_WALK)
def concept_depths(i):
    return gr.concept_depths(i.fx_edges)


@query("node_children", "SELECT statement, child, weight, ord FROM fx_edges WHERE parent = 'N3'")
def node_children(i):
    return gr.children_of(i.fx_edges, "N3").select("statement", "child", "weight", "ord")


@query("statement_roles", """
WITH r AS (SELECT cik AS accn, position, CASE WHEN cik % 2 = 0 AND position = 1 THEN 'http://x/role/ConsolidatedStatementsOfIncomeParenthetical' WHEN position = 2 THEN 'http://x/role/ConsolidatedStatementsOfIncome'
   WHEN position = 3 THEN 'http://x/role/ResultsOfOperations' WHEN position = 4 THEN 'http://x/role/CONSOLIDATEDBALANCESHEETS' ELSE 'http://x/role/StatementsOfCashFlows' END AS role FROM fx_company, (SELECT unnest(range(1, 6)) AS position) g)
SELECT accn, s AS statement, arg_min(role, position) AS role FROM (SELECT *, CASE WHEN contains(upper(role), 'PARENTHETICAL') THEN NULL WHEN contains(upper(role), 'INCOME') OR contains(upper(role), 'RESULTS') THEN 'income' WHEN contains(upper(role), 'BALANCE') THEN 'balance' ELSE 'cashflow' END AS s FROM r) t WHERE s IS NOT NULL GROUP BY accn, s
""")
def statement_roles(i):
    base = "http://x/role/"
    r = i.fx_company.select(F.col("cik").alias("accn"), "cik", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("position"))
    p = F.col("position")
    role = (
        F.when((F.col("cik") % 2 == 0) & (p == 1), "ConsolidatedStatementsOfIncomeParenthetical").when(p == 2, "ConsolidatedStatementsOfIncome")
        .when(p == 3, "ResultsOfOperations").when(p == 4, "CONSOLIDATEDBALANCESHEETS").otherwise("StatementsOfCashFlows")
    )
    return gr.statement_roles(r.withColumn("role", F.concat(F.lit(base), role)))


SEEDS = [("revenue", "income", "Revenues", 1), ("revenue", "income", "RevenueFromContractWithCustomerExcludingAssessedTax", 2),
         ("net_income", "income", "NetIncomeLoss", 1), ("operating_income", "income", "OperatingIncomeLoss", 1)]

TREE_WALK = """p AS (SELECT accn, tree, statement, child, arg_max(parent, ord) FILTER (WHERE true) AS parent FROM fx_trees GROUP BY ALL),
w AS (SELECT accn, tree, statement, child, child AS at, 0 AS depth, []::varchar[] AS seen FROM p
  UNION ALL SELECT w.accn, w.tree, w.statement, w.child, p.parent, w.depth + 1, list_append(w.seen, w.at) FROM w JOIN p ON p.accn = w.accn AND p.tree = w.tree AND p.child = w.at WHERE p.parent IS NOT NULL AND NOT list_contains(w.seen, w.at)),
d AS (SELECT accn, tree, statement, child, max(depth)::int AS depth FROM w GROUP BY ALL)"""


@query("filing_tree_depths", f"WITH RECURSIVE {TREE_WALK} SELECT * FROM d")
def filing_tree_depths(i):
    return gr.concept_depths(i.fx_trees, ("accn", "tree", "statement"))


@query("graph_resolve", f"""
WITH RECURSIVE {TREE_WALK},
s(metric, statement, concept, priority) AS (VALUES {", ".join(map(str, SEEDS))}),
n AS (SELECT accn, tree, metric, d.child AS concept, 0 AS extra, priority AS rk FROM d JOIN s ON d.statement = s.statement AND d.child = s.concept
  UNION ALL SELECT accn, tree, 'revenue', child, 1, depth FROM d WHERE regexp_matches(lower(child), 'revenue|netsales|salesnet|turnover') AND NOT regexp_matches(lower(child), 'cost|deferred|unearned|remaining|expense|receivable|guidance|contract(asset|liabilit)|taxespayable')
    AND child NOT IN (SELECT concept FROM s WHERE metric = 'revenue')),
g AS (SELECT accn, cik, report_date AS end_date, filed FROM fx_filings WHERE form = '10-K'),
k AS (SELECT g.accn, g.cik, g.end_date, f.concept, f.value, row_number() OVER (PARTITION BY g.accn, g.end_date, f.concept ORDER BY f.filed DESC, f.value DESC) AS rn
  FROM g JOIN fx_facts f ON f.cik = g.cik AND f.end_date = g.end_date AND f.filed <= g.filed WHERE f.value IS NOT NULL AND f.dimension IS NULL AND f.start_date = make_date(year(f.end_date), 1, 1)),
h AS (SELECT k.*, n.metric, n.tree, row_number() OVER (PARTITION BY k.accn, n.metric ORDER BY CASE n.tree WHEN 'calc' THEN 0 ELSE 1 END, extra, rk, k.concept) AS pick FROM k JOIN n ON n.accn = k.accn AND n.concept = k.concept WHERE k.rn = 1)
SELECT accn, cik, end_date, metric, value, concept || ' (graph_' || tree || ')' AS source, CASE tree WHEN 'calc' THEN 0.97 ELSE 0.93 END::double AS confidence FROM h WHERE pick = 1
""")
def graph_resolve(i):
    facts = i.fx_facts.where("dimension IS NULL AND start_date = make_date(year(end_date), 1, 1)")
    filings = i.fx_filings.where("form = '10-K'").withColumnRenamed("report_date", "end_date")
    depths = gr.concept_depths(i.fx_trees, ("accn", "tree", "statement"))
    seeds = i.spark.createDataFrame(SEEDS, "metric string, statement string, concept string, priority int")
    return gr.graph_resolve(facts, filings, depths, seeds)
