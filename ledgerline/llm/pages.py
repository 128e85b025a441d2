"""Main text of web pages by ratios of text and punctuation per tag path."""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|select|button)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
    r".*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
_PUNCT = re.compile(r"[.,;:!?。，、；：！？…]")

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose text is never the article's.
_ASIDE = frozenset("head nav footer aside form menu dialog fieldset".split())
# Words of class, id and role that name what surrounds an article.
_ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies "
    "consent disqus footer form login masthead menu modal nav navbar navigation newsletter notice notices notification popup "
    "promo promotion related replies respond share sharing sidebar signup skyscraper social sponsor sponsored subscribe "
    "subscription toolbar topbar widget".split()
)
# An end tag may be left out: a start of the second kind closes the first.
_CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
           "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")),
           "option": frozenset(("option",))}
_HOLDS = frozenset("article aside body div section main table ul ol dl td th blockquote html nav form".split())
_BLOCKS_CLOSE_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

KEEP = 0.25
WIDTH = 1.0


# Before such a name a class only says that the part is there or not.
_SAYS = re.compile(r"(?<![a-z])(?:has|no|with|without|have|hide|show)[-_]+[^\s\"']*")


def _named_aside(attrs: str) -> bool:
    for name, value in _ATTR.findall(attrs):
        if name.lower() != "hidden" and set(_NAME.findall(_SAYS.sub(" ", value.lower()))) & _ASIDE_NAMES:
            return True
    return False


def _hidden(attrs: str) -> bool:
    return any(name.lower() == "hidden" for name, _ in _ATTR.findall(attrs))


def _wrappers(found: list, named: list[dict], free_article: bool) -> set[int]:
    """Marked elements that wrap the article, so that their names don't count.

    Those that hold the page's main element; or, if no article or main element
    is outside marked ones, those that hold the article with the most fused mass
    or, without any article, more than half of the page's fused mass.
    """
    mass = [0.0] * len(named)
    total = 0.0
    for _, aside, inside, text in found:
        if not aside:
            own = (len(text) * (1 + len(_PUNCT.findall(text)))) ** 0.5
            total += own
            for k in inside:
                mass[k] += own
    out = {k for k, e in enumerate(named) if e["main"]}
    if not free_article and not out:
        held = [k for k, e in enumerate(named) if e["article"]]
        least = max((mass[k] for k in held), default=total) / 2
        out |= {k for k in held or range(len(named)) if mass[k] > least}
    return out


def blocks(page: str) -> list[tuple[tuple[str, ...], bool, str]]:
    """(tag path, inside a part that surrounds the article, text) of each block in page order.

    Inline elements don't enter the path. An end tag that fits no open element
    is ignored; elements still open at the end of a cut page are closed there.
    A part surrounds the article by its tag, or by its names unless it wraps the
    article itself.
    """
    stack: list[tuple[str, bool, int | None]] = []
    found, piece, at = [], [], 0
    named: list[dict] = []
    free_article = False

    def flush() -> None:
        text = " ".join("".join(piece).split())
        piece.clear()
        if text:
            inside = [k for _, _, k in stack if k is not None]
            found.append((tuple(t for t, _, _ in stack), any(a for _, a, _ in stack), inside, text))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            continue
        if tag in _VOID:
            piece.append(" ")
            continue
        if m["end"]:
            if any(t == tag for t, _, _ in stack):
                flush()
                while stack.pop()[0] != tag:
                    pass
            continue
        flush()
        shut = _CLOSES.get(tag, ())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in shut or (stack[k][0] == "p" and tag in _BLOCKS_CLOSE_P):
                del stack[k:]
                break
            if stack[k][0] in _HOLDS:
                break
        within = any(t in ("article", "main") for t, _, _ in stack)
        aside = tag in _ASIDE or (tag == "header" and not within)
        if not m["attrs"].rstrip().endswith("/"):
            own = None
            if tag in ("article", "main"):
                marks = [k for _, _, k in stack if k is not None]
                free_article |= not marks and not any(a for _, a, _ in stack)
                for k in marks:
                    named[k][tag] = True
            elif tag not in ("html", "body"):
                aside = aside or _hidden(m["attrs"])
                if _named_aside(m["attrs"]):
                    own = len(named)
                    named.append({"article": False, "main": False})
            stack.append((tag, aside, own))
    piece.append(html.unescape(page[at:]))
    flush()
    wraps = _wrappers(found, named, free_article)
    return [(path, aside or any(k not in wraps for k in inside), text) for path, aside, inside, text in found]


def _smooth(values: np.ndarray, width: float) -> np.ndarray:
    reach = int(3 * width)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def main_text(page: str | None, keep: float = KEEP, width: float = WIDTH) -> str:
    """The article of one page, blocks joined by an empty line; empty if there is none.

    Each root-to-leaf tag path gets the mean text length and the mean number of
    punctuation marks of its nodes. Both ratios are smoothed along the page and
    fused by their geometric mean; a node in a surrounding part counts as zero. A
    path whose fused ratio, at its best node, reaches ``keep`` of the page's best
    is content. The elements that hold content paths are the article: their
    headings and other short blocks belong to it, surrounding parts inside don't.
    """
    nodes = blocks(page or "")
    free = [i for i, (_, aside, _) in enumerate(nodes) if not aside]
    if not free:
        return ""
    chars, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, aside, text in nodes:
        chars[path, aside] += len(text)
        marks[path, aside] += len(_PUNCT.findall(text))
        count[path, aside] += 1
    ratios = np.array([[0.0, 0.0] if a else [chars[p, a] / count[p, a], 1 + marks[p, a] / count[p, a]] for p, a, _ in nodes])
    fused = np.sqrt(_smooth(ratios[:, 0], width) * _smooth(ratios[:, 1], width))
    best: dict = defaultdict(float)
    for i in free:
        best[nodes[i][0]] = max(best[nodes[i][0]], fused[i])
    inside = [p for p in best if "article" in p or "main" in p]
    top = max(best[p] for p in inside or best)
    content = {p for p in inside or best if best[p] >= keep * top}
    holders = set()
    for p in content:
        k = max((i for i, t in enumerate(p) if t in ("article", "main")), default=None)
        holders.add(p[: k + 1] if k is not None else p[:-1] if len(p) > 1 else p)

    def belongs(path: tuple[str, ...]) -> bool:
        if path in content:
            return True
        for h in holders:
            if path[: len(h)] == h:
                if h[-1:] not in (("body",), ("html",)) or path[len(h) :][:1] and path[len(h)] in _HEADINGS:
                    return True
        return False

    return "\n\n".join(nodes[i][2] for i in free if belongs(nodes[i][0]))


def extract(pages: DataFrame, keep: float = KEEP, width: float = WIDTH, page: str = "html") -> DataFrame:
    """``pages`` with main_text and main_chars (its code points) in place of the html column.

    A page is one row and is worked on by itself. NULL and empty html, and pages
    without an article, give an empty text; repeated rows each give theirs; no
    rows give no rows; other columns stay, main_text and main_chars are replaced.
    """

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, keep, width) for x in texts], dtype="object")

    others = [c for c in pages.columns if c not in (page, "main_text", "main_chars")]
    out = pages.select(*others, of(F.coalesce(F.col(page), F.lit(""))).alias("main_text"))
    return out.withColumn("main_chars", F.length("main_text").cast("long"))
