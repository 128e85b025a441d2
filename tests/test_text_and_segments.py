import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerline.operators import graph as gr
from ledgerline.operators import sections as se
from ledgerline.operators import segments as sg
from ledgerline.operators import text as tx


def brute_subtotals(values):
    rows, i = list(values), 0
    while i < len(rows) and len(rows) > 2:
        others = rows[:i] + rows[i + 1:]
        hit = len(others) <= 10 and any(
            sum(c) and abs(sum(c) - rows[i]) / rows[i] < 0.001
            for k in range(2, len(others) + 1) for c in itertools.combinations(others, k)
        )
        if hit:
            rows.pop(i)
        else:
            i += 1
    return rows


def test_subtotals_match_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        values = [float(rnd.randrange(1, 30)) for _ in range(rnd.randrange(2, 9))]
        values.append(sum(values[:2]))
        values.sort(reverse=True)
        kept = [v for v, k in zip(values, sg._kept(np.array(values))) if k]
        assert kept == brute_subtotals(values)


def test_large_groups_keep_all_members(spark):
    rows = [(1, 2020, "a", f"m{n}", float(n + 1)) for n in range(40)]
    df = spark.createDataFrame(rows, "cik long, fy int, axis string, label string, value double")
    assert sg.drop_subtotals(df).count() == 40


def test_amounts(spark):
    line = "Europe $ 1,234.5 and 2.5 billion, 7 m, 300"
    got = spark.range(1).select(sg.amounts(F.lit(line))).first()[0]
    assert got == [1234.5, 2.5e9, 7e6, 300.0]


FILLER = "The company sells goods in many places and reports once a year. " * 5


def test_regional_table_by_column(spark):
    text = FILLER + "\nGeographic information (in millions)\nAmericas  Europe  GreaterChina  Japan  Total\nNet sales $ 100  $ 60  $ 30  $ 10  $ 200\n"
    rows = sg.geographic_table(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert {r.label: (r.value, r.pct) for r in rows} == {
        "Americas": (1e8, 50.0), "Europe": (6e7, 30.0), "Greater China": (3e7, 15.0), "Japan": (1e7, 5.0)}


def test_regional_table_infers_scale_and_drops_subsets(spark):
    text = FILLER + "\nRevenue by region\nGreater China   $300\nChina   $200\nJapan   $100\nTotal $400\n"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    totals = spark.createDataFrame([(1, 4.0e8)], "doc_id int, total_revenue double")
    rows = sg.geographic_table(docs, totals).collect()
    assert {r.label: r.value for r in rows} == {"Greater China": 3e8, "Japan": 1e8}


def test_segment_table_drops_parent_and_noise(spark):
    text = FILLER + "\nRevenue by segment\nProducts $1,000\nPhones $600\nTablets $400\nEliminations $(5)\nRevenue increased for the year by $12\n"
    rows = sg.segment_table(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert {r.label for r in rows} == {"Phones", "Tablets"}


def test_html_to_text(spark):
    html = ("<html><head><style>x{}</style></head><body><h1>Item <b>1</b></h1><p>B<span>USINESS</span></p><div style='display: none'>hidden"
            "<p>x</p></div><table><tr><td>a</td><td> b </td></tr><tr><th></th></tr></table>tail<br>end<script>no()</script></body></html>")
    got = spark.createDataFrame([(html,)], "html string").select(tx.html_to_text("html")).first()[0]
    assert got == "Item 1\n\nBUSINESS\na b\ntail\n\nend"


def test_anchored_section_takes_the_last_mention(spark):
    html = "<p>Item 7. in contents</p><a id='item_7'></a><p>Body text</p><p>more</p>"
    df = spark.createDataFrame([(html,), ("<p>none</p>",)], "html string")
    got = [r[0] for r in df.select(tx.anchored_section("html", "7")).collect()]
    assert got == ["Body text\nmore", None]


def test_phrase_search_matches_containment(spark):
    docs = [(1, "The quick brown fox\njumps over"), (2, "quick  brown foxes"), (3, "unquick brown foxy jumps"), (4, "brown"), (5, "x fox\njumps")]
    phrases = [(1, "uick brown fo"), (2, "brown"), (3, "quick brown fox"), (4, "fox\njumps over"), (5, "rown fo"), (6, "no such phrase here")]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    p = spark.createDataFrame(phrases, "item_id int, phrase string")
    got = {(r.doc_id, r.item_id) for r in tx.phrase_search(d, p).collect()}
    assert got == {(i, j) for i, t in docs for j, w in phrases if w in t.lower()}


def test_phrases_cut_from_texts_are_found(spark):
    """Random pieces of random texts, any length and cut, and changed ones, against plain containment."""
    rnd = random.Random(8)
    word = lambda: rnd.choice(["a", "of", "the", "Fox", "brown,", "jumps", "over.", "the", "x" * 30])
    texts = ["".join(word() + rnd.choice([" ", "  ", "\n", " \t"]) for _ in range(rnd.choice([1, 3, 40, 120]))) for _ in range(40)] + ["", " ", None]
    phrases = []
    for _ in range(250):
        t = rnd.choice(texts[:40])
        a = rnd.randrange(len(t))
        cut = t[a : a + rnd.choice([1, 2, 5, 12, 40, 200, 900])]
        phrases.append(cut if rnd.random() < 0.7 else cut[: len(cut) // 2] + rnd.choice(["", " ", "q", "the "]) + cut[len(cut) // 2 :])
    phrases += ["", "  ", "the the the the", "not there at all in any of the texts"]
    d = spark.createDataFrame([*enumerate(texts), (3, "the brown, fox")], "doc_id int, text string")
    p = spark.createDataFrame(list(enumerate(phrases)), "item_id int, phrase string")
    got = sorted({(r.doc_id, r.item_id) for r in tx.phrase_search(d, p).collect()})
    rows = [*enumerate(texts), (3, "the brown, fox")]
    assert got == sorted({(i, j) for i, t in rows if t is not None for j, w in enumerate(phrases) if w.strip(" \n\t\r") and w.lower() in t.lower()})


def test_texts_stay_where_they_are(spark):
    """No exchange of a phrase search carries a text or its pieces."""
    d = spark.createDataFrame([(1, "the quick brown fox")], "doc_id int, text string")
    p = spark.createDataFrame([(1, "he quick brown f")], "item_id int, phrase string")
    df = tx.phrase_search(d, p)
    assert df.collect() == [(1, 1)]
    tree = df._jdf.queryExecution().executedPlan()
    seen, stack = 0, [tree.initialPlan() if hasattr(tree, "initialPlan") else tree]
    while stack:
        node = stack.pop()
        if node.nodeName() == "Exchange":
            seen += 1
            names = [node.output().apply(k).name() for k in range(node.output().size())]
            assert not {"text", "__t", "__text"} & set(names)
        stack += [node.children().apply(k) for k in range(node.children().size())]
    assert seen


def test_executives_and_signers(spark):
    texts = [
        (1, "we, Chief Executive Officer, Ann B. Smith and"), (2, "Carl Jones - Chief Executive Officer"), (3, "its CEO Dora Young"), (4, "Eve Stone, CEO"),
        (5, "the chief executive officer"), (6, None), (7, "x" * 50_000 + " CEO, Ann Bee"), (8, "Carl Jones, CEO. Chief Executive Officer, Ann Smith"),
    ]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    got = {r[0]: r[1] for r in df.select("doc_id", tx.chief_executive("text")).collect()}
    assert got == {1: "Ann B. Smith", 2: "Carl Jones", 3: "Dora Young", 4: "Eve Stone", 5: None, 6: None, 7: "Ann Bee", 8: "Ann Smith"}
    page = "/s/ Ann B. Smith\nDirector\n/s/ Carl Jones\n/s/ Dora Young\n\n2024\nVice President\nChief of all\n/s/ x\n  /s/ Eve Stone  \n\n\n\nDirector"
    signed = tx.signed_by(spark.createDataFrame([(1, page), (2, "none"), (3, None)], "doc_id int, text string"))
    assert {tuple(r) for r in signed.collect()} == {(1, "Ann B. Smith", "Director"), (1, "Carl Jones", None), (1, "Dora Young", "Vice President"), (1, "Eve Stone", None)}


def test_chunks(spark):
    words = [f"w{n}" for n in range(10)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "a b"), (3, "  ")], "doc_id int, text string")
    got = {(r.doc_id, r.chunk_no): r.chunk for r in tx.chunk_text(df, 4, 1).collect()}
    assert got[2, 0] == "a b" and (3, 0) not in got
    assert [got[1, k] for k in range(3)] == ["w0 w1 w2 w3", "w3 w4 w5 w6", "w6 w7 w8 w9"] and (1, 3) not in got


def test_model_hook(spark):
    import pandas as pd
    df = spark.createDataFrame([(1, "abc"), (2, "de")], "doc_id int, chunk string")
    out = tx.score_chunks(df, lambda s: pd.DataFrame({"size": s.str.len().astype(float)}), "size double")
    assert {(r.doc_id, r.size) for r in out.collect()} == {(1, 3.0), (2, 2.0)}


def report(parts):
    return "\n".join(parts)


def test_sections_skip_the_contents_list(spark):
    body = ["plain words that make up a long line of real content in this section " * 3] * 3 + ["filler"] * 60
    toc = [f"Item {t} {n}" for n, t in enumerate(["1. Business", "1A. Risk Factors", "2. Properties", "3. Legal Proceedings", "4. Mine Safety", "7. Management's Discussion"])]
    lines = toc + ["filler"] * 60
    want = {}
    for item, head in (("1", "Item 1. B"), ("1A", "ITEM 1A - Risk Factors"), ("2", "Item 2: Properties"), ("3", "Item 3. Legal Proceedings"),
                       ("4", "Item 4. Mine Safety"), ("7", "Item 7. Management's Discussion")):
        want[item] = len(lines)
        lines += [head] + (["USINESS"] if item == "1" else []) + body
    sig = len(lines)
    lines += ["/s/ A", "/s/ B", "/s/ C"]
    df = spark.createDataFrame([(1, report(lines))], "doc_id int, text string")
    got = {r.item: (r.start_line, r.end_line) for r in se.segment(df).collect()}
    assert {k: v[0] for k, v in got.items()} == want and got["7"][1] == sig


def test_reference_stub_leads_to_the_content(spark):
    lines = ["MANAGEMENT'S DISCUSSION"] + ["real content of the discussion in one line"] * 40
    lines += ["Item 7. Management's Discussion", "The text is on pages 3 to 9, incorporated by reference.", "Item 8. Financial Statements and Supplementary Data", "x"]
    df = spark.createDataFrame([(1, report(lines))], "doc_id int, text string")
    row = se.section_text(df, se.segment(df)).where("item = '7'").first()
    assert row.is_stub and row.text.startswith("MANAGEMENT'S DISCUSSION\nreal content")


def test_cycles_and_roots(spark):
    edges = [("s", "b", "a", 1), ("s", "c", "b", 2), ("s", "x", "y", 3), ("s", "y", "x", 4), ("s", "c", "a", 1)]
    df = spark.createDataFrame(edges, "statement string, child string, parent string, ord int")
    got = {r.child: r.depth for r in gr.concept_depths(df).collect()}
    assert got == {"b": 1, "c": 2, "x": 2, "y": 2}


def walked_depths(parent_of):
    """Depths by walking up node by node; every place counts once."""
    out = {}
    for node in parent_of:
        at, seen = node, set()
        while parent_of.get(at) and at not in seen:
            seen.add(at)
            at = parent_of[at]
        out[node] = len(seen)
    return out


def test_depths_of_long_paths_wide_trees_and_cycles(spark):
    rng = np.random.default_rng(11)
    trees = {"path": {f"n{k}": f"n{k - 1}" for k in range(1, 1001)} | {"n0": None}}
    trees["star"] = {f"leaf{k}": "hub" for k in range(500)} | {"hub": "top"}
    trees["ring"] = {f"r{k}": f"r{(k + 1) % 37}" for k in range(37)} | {f"t{k}": f"t{k + 1}" if k < 20 else "r5" for k in range(21)}
    trees["self"] = {"me": "me", "after": "me"}
    for t in range(5):
        n = 60
        trees[f"random{t}"] = {f"v{k}": f"v{int(rng.integers(n))}" if rng.random() < 0.9 else None for k in range(n)}
    rows = [(s, c, p, 1) for s, tree in trees.items() for c, p in tree.items()]
    df = spark.createDataFrame(rows, "statement string, child string, parent string, ord int")
    got = {(r.statement, r.child): r.depth for r in gr.concept_depths(df).collect()}
    assert got == {(s, c): d for s, tree in trees.items() for c, d in walked_depths(tree).items()}
    assert gr.concept_depths(df.limit(0)).count() == 0


def test_filing_resolution_takes_what_was_known_then(spark):
    facts = spark.createDataFrame([
        (1, "2020-12-31", "Revenues", 10.0, "2021-02-01"), (1, "2020-12-31", "Revenues", 11.0, "2022-02-01"),
        (1, "2020-12-31", "acme_NetSales", 9.0, "2021-02-01"), (1, "2020-12-31", "CostOfRevenue", 5.0, "2021-02-01"), (1, "2020-12-31", "Revenues", None, "2021-02-02"),
    ], "cik long, end_date string, concept string, value double, filed string")
    filings = spark.createDataFrame([("a", 1, "2020-12-31", "2021-03-01"), ("b", 1, "2020-12-31", "2022-03-01"), ("c", 1, "2020-12-31", "2022-03-01"),
                                     ("d", 1, "2020-12-31", "2020-12-31")], "accn string, cik long, end_date string, filed string")
    depths = spark.createDataFrame([
        ("a", "pres", "income", "Revenues", 2), ("b", "calc", "income", "Revenues", 1), ("b", "pres", "income", "Revenues", 1),
        ("c", "pres", "income", "Revenues", 1), ("c", "calc", "income", "acme_NetSales", 3), ("c", "calc", "income", "CostOfRevenue", 0),
        ("d", "calc", "income", "Revenues", 1)], "accn string, tree string, statement string, child string, depth int")
    seeds = spark.createDataFrame([("revenue", "income", "Revenues", 1)], "metric string, statement string, concept string, priority int")
    got = {r.accn: (r.value, r.source, r.confidence) for r in gr.graph_resolve(facts, filings, depths, seeds).collect()}
    assert got == {"a": (10.0, "Revenues (graph_pres)", 0.93), "b": (11.0, "Revenues (graph_calc)", 0.97), "c": (9.0, "acme_NetSales (graph_calc)", 0.97)}
