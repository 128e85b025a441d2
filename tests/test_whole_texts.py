"""Texts, rows and names beyond any fixed size are worked on whole."""

import random

from pyspark.sql import functions as F

from ledgerline.operators import entities as en
from ledgerline.operators import periods as pr
from ledgerline.operators import sections as se
from ledgerline.operators import segments as sg
from ledgerline.operators import text as tx
from ledgerline.sources import documents as sd


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_paragraphs_that_begin_alike_stay_apart(spark):
    head = "the same opening words " * 10
    old = spark.createDataFrame([(1, head + "first end\n\n" + "kept")], "k int, text string")
    new = spark.createDataFrame([(1, head + "second end\n\nkept\n\n" + "x" * 9000)], "k int, text string")
    r = tx.diff_sections(old, new, ["k"]).first()
    assert (r["n_added"], r["n_removed"]) == (2, 1)
    assert r["removed_text"] == head + "first end" and r["added_text"] == head + "second end\n\n" + "x" * 9000


def test_signatures_late_in_a_text(spark):
    df = spark.createDataFrame([("w " * 5000 + "Power of Attorney",), ("w " * 9000 + "/s/ Ann /s/ Bob /s/ Cy",), ("w " * 9000,)], "t string")
    assert [r[0] for r in df.select(tx.is_signature_block(F.col("t"))).collect()] == [True, True, False]


def test_long_redirected_section(spark):
    body = "\n".join(f"line {n} of the discussion" for n in range(1200))
    stub = "Item 7. Management's Discussion\nSee the pages incorporated by reference.\nItem 8. Financial Statements\nbody"
    docs = spark.createDataFrame([(1, f"MANAGEMENT'S DISCUSSION\n{body}\n{stub}")], "doc_id int, text string")
    at = spark.createDataFrame([(1, "7", 1201, 1203)], "doc_id int, item string, start_line int, end_line int")
    r = se.section_text(docs, at).first()
    assert r["is_stub"] and "line 1199 of the discussion" in r["text"]


def test_anchored_section_of_any_length(spark):
    page = "<p>Item 7. Contents</p><a id='item_7'></a><p>Item 7. Real</p>" + "<p>words</p>" * 40_000 + "<p>Item 8. Next</p><p>tail</p>"
    df = spark.createDataFrame([(page,), ("<p>nothing here</p>",), (None,), ("<p>Item 7. A<p>Item 8. B",)], "h string")
    got = [r[0] for r in df.select(tx.anchored_section("h", "7")).collect()]
    assert got[0] == "\n".join(["Item 7. Real"] + ["words"] * 40_000)
    assert got[1:] == [None, None, "Item 7. A"]


def test_containing_meets_parts_of_any_length(spark):
    names = spark.createDataFrame([("alphabet",), ("beta",), ("z",), ("",), (None,)], "name string")
    parts = spark.createDataFrame([("a",), ("et",), ("phab",), ("z",), ("",), ("beta!",)], "part string")
    df = tx.containing(names, "name", parts, "part")
    assert sorted(map(tuple, df.collect())) == [("alphabet", "a"), ("alphabet", "et"), ("alphabet", "phab"), ("beta", "a"), ("beta", "et"), ("z", "z")]
    assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)


def test_plans_have_no_cross_joins(spark):
    docs = spark.createDataFrame([(1, "An alphabet of words")], "doc_id long, text string")
    phrases = spark.createDataFrame([(1, "phab"), (2, "of words"), (3, "an alphabet of")], "item_id long, phrase string")
    found = tx.phrase_search(docs, phrases)
    assert sorted(r["item_id"] for r in found.collect()) == [1, 2, 3]
    xml = "<informationTable><infoTable><nameOfIssuer>Acme Corp</nameOfIssuer><value>1</value><shrsOrPrnAmt><sshPrnamt>2</sshPrnamt></shrsOrPrnAmt></infoTable></informationTable>"
    held = sd.holding_reports(spark.createDataFrame([("f", xml)], "filer string, xml string"), spark.createDataFrame([("ACME",)], "issuer_key string"))
    assert held.count() == 1
    for df in (found, held):
        assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)


def test_aliases_as_long_as_the_table_has(spark):
    texts = spark.createDataFrame([(1, "we met one two three four five six today")], "id int, text string")
    aliases = spark.createDataFrame([("one two three four five six", "LONG"), ("four", "SHORT")], "alias string, ticker string")
    assert [r["ticker"] for r in en.resolve_alias(texts, aliases, "id", "text").collect()] == ["LONG"]


def test_more_than_a_dozen_periods(spark):
    rows = spark.createDataFrame([(1, f"20{n:02d}-12-31", 2000 + n) for n in range(20)], "cik int, end_date string, fy int")
    got = pr.newest_periods(rows.withColumn("end_date", F.to_date("end_date")), 15)
    assert got.count() == 15


def test_subtotals_in_groups_of_any_size(spark):
    from itertools import combinations

    import numpy as np


    def plain(target, others):
        return any(abs(sum(c) - target) / target < 0.001 for k in range(2, len(others) + 1) for c in combinations(others, k))

    rnd = np.random.default_rng(3)
    for _ in range(150):
        values = np.sort(np.round(rnd.exponential(100, int(rnd.integers(2, 9))) + 1, 2))[::-1]
        assert sg._is_sum(values[0], values[1:]) == plain(values[0], values[1:].tolist())
    # Powers of three have no sums among themselves; the first of each group adds up two others.
    few = [3.0**k for k in range(19)]
    many = [3.0**k for k in range(60)]
    rows = [(1, f"m{k}", v) for k, v in enumerate(few)] + [(1, "sum", few[-1] + few[-2])]
    rows += [(2, f"m{k}", v) for k, v in enumerate(many)] + [(2, "sum", many[-1] + many[-2])]
    df = spark.createDataFrame([(c, 2020, "a", lab, v) for c, lab, v in rows], "cik int, fy int, axis string, label string, value double")
    got = sg.drop_subtotals(df, max_others=None).groupBy("cik").agg(F.count("*").alias("n"), F.max("label").alias("last")).collect()
    assert {r["cik"]: r["n"] for r in got} == {1: 19, 2: 60} and all(r["last"] != "sum" for r in got)


def test_tables_of_any_length_and_distance_are_read_whole(spark):

    filler = "The company sells goods in many markets and says so at length here.\n" * 90
    lines = "".join(f"Line {chr(65 + k)}{chr(97 + k)} .... ${100 + k}\n" for k in range(12))
    text = f"Revenue by segment\n{filler}Amounts (in millions)\n{lines}"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = {r["label"]: r["value"] for r in sg.segment_table(df).collect()}
    assert got == {f"Line {chr(65 + k)}{chr(97 + k)}": (100 + k) * 1e6 for k in range(12)}
    text = f"Revenue by geography (in thousands)\n{filler}Africa   $5,000\nEurope   $7,000\n"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert {r["label"]: r["value"] for r in sg.geographic_table(df).collect()} == {"Africa": 5e6, "Europe": 7e6}


def test_all_regions_in_rows_and_in_columns(spark):
    """Every name that only its own pattern matches, against a plain reading of the table."""
    import re

    names = [n for n in dict.fromkeys(label for _, label in sg.GEO_TEXT) if [label for p, label in sg.GEO_TEXT if re.search(p, n)] == [n]]
    assert len(names) > 50 and {"Sweden", "UAE", "Chile", "Philippines", "Nigeria"} <= set(names)
    values = {n: 10_000.0 + 7 * k for k, n in enumerate(names)}
    rows = "\n".join(f"{n}   ${v:,.0f}   $1" for n, v in values.items())
    heads = " | ".join(names) + "\nNet sales " + "  ".join(f"$ {v:,.0f}" for v in values.values())
    odd = "Revenue by region\nTürkiye $ 5,000\nU.S. $ 6,000\nUnited Arab Emirates $ 7,000\nNorth Macedonia $ 9\nFrance and others " + "x" * 300 + " $ 3\n"
    docs = [(1, f"Geographic information\n{rows}\nTotal $ 99"), (2, f"Geographic area\n{heads}\n"), (3, odd), (4, "no table"), (5, None)]
    got = {}
    for r in sg.geographic_table(spark.createDataFrame(docs, "doc_id int, text string")).collect():
        got.setdefault(r.doc_id, {})[r.label] = r.value
    gone = {child for child, parent in sg.SUBSETS if parent in values}
    assert got[1] == got[2] == {n: v for n, v in values.items() if n not in gone}
    assert got[3] == {"Turkey": 5000.0, "United States": 6000.0, "UAE": 7000.0}
    assert set(got) == {1, 2, 3}


def plain_business_sections(text):
    """Each name with the text that follows it, read again for every name."""
    import re

    out = {}
    for m in re.finditer(sg.BUSINESS_LINE, text, re.M):
        label, after = m.group(1).strip(), text[m.end() : m.end() + sg.BUSINESS_REACH]
        if re.match(sg.NOT_BUSINESS, label, re.I) or label.lower() in sg.REGION_NAMES[:17] or not re.search(sg.BUSINESS_TABLE, after, re.I):
            continue
        hit = re.search(sg.BUSINESS_REVENUE, after, re.I)
        value = float(hit.group(1).replace(",", "")) if hit else 0
        if value > 0 and not 1900 <= value <= 2100:
            out[label] = max(value, out.get(label, 0))
    return out


def test_business_sections_against_a_plain_reading(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randrange(40)):
            lines.append(rng.choice([
                "Institutional Securities", "Wealth Management", "Europe", "Income tax", "Investment & Trading", "Income Statement Information",
                "Statement of income (unaudited)", f"Net revenues  {rng.randrange(1, 90):,},{rng.randrange(100, 999)}", "Net revenue\n$ 2,000", "Total net revenues 4,100 3,000",
                "some words " * rng.randrange(1, 120), "", "Overview of it", "X Y",
            ]))
        texts.append("\n".join(lines))
    docs = spark.createDataFrame([*enumerate(texts), (99, None), (98, "")], "doc_id int, text string")
    got = {}
    for r in sg.business_sections(docs).collect():
        got.setdefault(r.doc_id, {})[r.label] = r.value
    want = {k: w for k, w in ((k, plain_business_sections(t)) for k, t in enumerate(texts)) if w}
    assert got == want and sum(map(len, want.values())) > 40


def test_more_than_eight_businesses_without_a_heading(spark):
    names = ["Alpha", "Beta Works", "Gamma", "Delta", "Epsilon", "Zeta", "Eta Lines", "Theta", "Iota", "Kappa"]
    body = "\n".join(f"{n}\nStatement of income (unaudited)\nNet revenues  {10 + k},000" for k, n in enumerate(names))
    docs = spark.createDataFrame([(1, "Figures (in millions)\n" + body), (2, "figures\nAlpha\nStatement of income (x)\nNet revenues 5,000")], "doc_id int, text string")
    got = {(r.doc_id, r.label): r.value for r in sg.segment_table(docs).collect()}
    assert got == {(1, n): (10 + k) * 1e9 for k, n in enumerate(names)}
