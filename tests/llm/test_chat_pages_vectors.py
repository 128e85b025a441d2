"""Chat round trips, page extraction and embedding links."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import chat, pages, vectors

PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "/", "s", ">", "\n", " ", "é", "x", "[", "]"])).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), PIECES), PIECES), max_size=5))
def test_render_and_parse_are_inverse(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert formatted.count("<s>") == formatted.count("</s>") == len(turns)


def log(spark, *rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, text string")


def test_fold_of_deltas_edits_and_regenerations(spark):
    events = log(
        spark, (1, 5, 2, "delta", "assistant", "wrong"), (1, 1, 1, "start", "user", None), (1, 2, 1, "delta", "user", "hel"),
        (1, 3, 1, "delta", "user", "lo"), (1, 4, 2, "start", "assistant", None), (1, 6, 2, "regenerate", "assistant", None),
        (1, 7, 2, "delta", "assistant", "ri"), (1, 8, 1, "edit", "user", "hi"), (1, 9, 2, "delta", "assistant", "ght"),
        (2, 1, 9, "delta", None, "no start"), (None, 1, 1, "start", "user", None),
    )
    got = {r["conv_id"]: r for r in chat.reconstruct(events).collect()}
    assert chat.parse(got[1]["formatted"]) == [("user", "hi"), ("assistant", "right")]
    assert chat.parse(got[2]["formatted"]) == [("", "no start")]
    assert chat.parse(got[None]["formatted"]) == [("user", "")]
    assert chat.reconstruct(events.limit(0)).collect() == []


def test_conversations_through_the_log(spark):
    rows = [(1, 0, "user", "a" * 1000), (1, 1, "assistant", "b\n" * 500), (1, 1, "assistant", "b\n" * 500), (2, None, None, None),
            (2, 0, "assistant", None), (3, 0, "user", chat.PROBE), (3, 1, "assistant", chat.PROBE), (None, 0, "user", "x")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    got = {r["conv_id"]: r for r in chat.digests(chat.reconstruct(chat.turn_events(table))).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted(((t is not None, t or 0), r or "", x or "") for c, t, r, x in rows if c == conv)
        whole = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        said = "".join(x for _, r, x in mine if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(mine), len(said))
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="page">
<header><h1>Site name, a longer motto of the site.</h1></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, and we would like you to accept all of them, now.</div><!-- <p>no</p> -->
<main><article><h2>Short title</h2><p>First   paragraph of the <b>article</b> &amp; more,\n with commas, and stops. It goes on.
<p>Second one, it&#39;s also long enough to count as text. Really.<aside><p>Read also: another article, which is long too.</p></aside>
<script>var x = "<p>not this</p>";</script><ul><li>A point<li>Another point</ul><p>End.</p>
<div class="ad">Buy this wonderful thing, it is cheap, it is good.</div></article></main>
<form><label>Your mail, please enter it here.</label><input></form><section id="comments"><p>A comment, by a reader, that is long. Very long.</p></section>
<footer><p>&copy; all of us, a long footer with commas, and stops.</p></footer></body></html>"""


def test_article_without_its_surroundings():
    assert pages.main_text(PAGE).split("\n\n") == [
        "Short title", "First paragraph of the article & more, with commas, and stops. It goes on.",
        "Second one, it's also long enough to count as text. Really.", "A point", "Another point", "End.",
    ]


def test_page_without_article_element():
    page = ("<body><div id=menu><a href=x>Home</a> <a href=y>News</a></div><div class=content><h1>Head</h1>"
            "<p>Long text, with marks, and more of it. And on it goes, for long.</p><p>Ok.</p></div><div class=footer>Imprint, all of it.</div>")
    assert pages.main_text(page) == "Head\n\nLong text, with marks, and more of it. And on it goes, for long.\n\nOk."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>x", "<nav>only a menu</nav>", "</p></div>", "<head><title>x</title></head>"])
def test_pages_without_text(page):
    assert pages.main_text(page) in ("", "<")


def test_cut_pages_and_odd_marks():
    assert pages.main_text("<article><p>a &lt;b&gt; &am") == "a <b> &am"
    assert pages.main_text("<article><p>1 < 2 and <b title='>'>bold</b>") == "1 < 2 and bold"
    assert pages.main_text("<article><p>one<br>two<p>three</article><p>") == "one two\n\nthree"
    assert pages.main_text("<article>" + "<p>word, and word.</p>" * 20_000).count("\n\n") == 19_999


def test_extract_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y")]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")).collect()
    assert sorted(r["main_chars"] for r in got) == [0, 0, len(pages.main_text(PAGE)), len(pages.main_text(PAGE))]
    assert set(got[0].__fields__) == {"page_id", "url", "main_text", "main_chars"}


def plain_links(data, cosine=0.9):
    good = {i: np.array(v, float) for i, v in data if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in good.items()}
    near = {i: [j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in unit}
    out = {}
    for i, _ in data:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near.get(i, [])), min(seen))
    return out


@pytest.mark.parametrize(("bucket", "block"), [(512, 2048), (8, 2048), (512, 30)])
def test_links_of_vectors(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rnd = np.random.default_rng(4)
    data = []
    for g in range(20):
        centre = rnd.standard_normal(16)
        for k in range(int(rnd.integers(1, 9))):
            data.append((10 * g + k, (centre + 0.12 * k * rnd.standard_normal(16)).astype(np.float32).tolist()))
    data += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [1.0, None] * 8), (305, [float("inf")] + [1.0] * 15),
             (306, data[0][1]), (307, [2 * x for x in data[0][1]]), (308, [1.0, 0.0]), (309, [1.0, 0.1]), (-5, data[1][1])]
    got = vectors.near_duplicates(spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<float>, n_links string"), bucket=bucket).collect()
    want = plain_links(data)
    found = {r["vec_id"]: r for r in got}
    assert set(found) == set(want)
    if bucket == 512:
        assert {k: (r["n_links"], r["component_id"]) for k, r in found.items()} == want
    else:
        assert sum(r["n_links"] for r in got) >= 0.9 * sum(n for n, _ in want.values())
    assert all(r["n_links"] <= want[k][0] and r["kept"] == (k == r["component_id"]) for k, r in found.items())


def test_vector_rows_that_repeat_or_lack_ids(spark):
    rows = [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [0.0, 1.0]), (None, None)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(str, ((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got))) == sorted(
        map(str, [(3, 2, 3, True), (3, 2, 3, True), (None, 2, 3, False), (None, 0, None, False), (None, 0, None, False)])
    )
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_estimates_are_unbiased_and_bounded():
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((400, 64))
    y = x + rnd.standard_normal((400, 64)) * rnd.uniform(0, 2, (400, 1))
    a, b = vectors.Codes(x), vectors.Codes(y)
    true = (a.units * b.units).sum(axis=1)
    estimate = (a.code * b.turned).sum(axis=1) / a.factor
    assert abs((estimate - true).mean()) < 0.02
    assert (a.upper(slice(0, 400), b).diagonal() >= true).mean() > 0.995


@pytest.mark.parametrize("wrapper", ["<div class='layout has-sidebar'>", "<div id='no-sidebar'>", "<section class='post related-topics'>", "<div class='widget text'>"])
@pytest.mark.parametrize("inner", ["", "article", "main"])
def test_names_of_a_wrapper_do_not_lose_the_article(wrapper, inner):
    from ledgerline.llm import pages

    body = [f"This is sentence {k} of the article, with commas, and enough words to be content." for k in range(5)]
    text = "".join(f"<p>{x}</p>" for x in body)
    text = f"<{inner}>{text}</{inner}>" if inner else text
    page = f"<html><body>{wrapper}{text}<div class='sidebar'><p>Short advert, really.</p></div></{wrapper[1:].split()[0]}></body></html>"
    assert pages.main_text(page) == "\n\n".join(body)
    # Comments as articles stay out where the article is outside of them.
    page = f"<body><article>{''.join(f'<p>{x}</p>' for x in body)}</article><div class='comments'><article><p>I say, no, never, and at some length too.</p></article></div></body>"
    assert pages.main_text(page) == "\n\n".join(body)
