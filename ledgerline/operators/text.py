"""Filing text: cleaning, search, paragraph diff, chunks, entities, labels."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numeric import safe_div
from ledgerline.session import ensure_checkpoint_dir

# Elements that start a line of their own.
BLOCK_TAGS = frozenset(
    "p div br h1 h2 h3 h4 h5 h6 li ol ul blockquote pre hr section article header footer nav tr table "
    "thead tbody tfoot dt dd dl figcaption figure".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)


class _Text(HTMLParser):
    """Visible text with line breaks at block elements and tabs between cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0
        self.open: list[tuple[str, bool]] = []
        self.row: list[str] | None = None
        self.cell: list[str] | None = None
        self.tables = 0

    def handle_starttag(self, tag, attrs):
        style = dict(attrs).get("style") or ""
        hides = tag in ("script", "style") or bool(_HIDDEN.search(style))
        if tag not in _VOID:
            self.open.append((tag, hides))
            self.skip += hides
        if self.skip:
            return
        if tag == "table":
            self.tables += 1
        if self.tables and tag == "tr":
            self.row = []
        elif self.tables and tag in ("td", "th") and self.row is not None:
            self.cell = []
        elif tag in BLOCK_TAGS and not self.tables:
            self.parts.append("\n\n" if tag in _VOID else "\n")

    def handle_endtag(self, tag):
        names = [t for t, _ in self.open]
        if tag not in names:
            return
        while self.open:
            name, hides = self.open.pop()
            self.skip -= hides
            if not self.skip and not hides:
                self._close(name)
            if name == tag:
                break

    def _close(self, tag):
        if tag in ("td", "th") and self.cell is not None and self.row is not None:
            text = "".join(s.strip() for s in self.cell)
            if text:
                self.row.append(text)
            self.cell = None
        elif tag == "tr" and self.row is not None:
            if self.row:
                self.parts.append("\t".join(self.row) + "\n")
            self.row = None
        elif tag == "table":
            self.tables = max(0, self.tables - 1)
        elif tag in BLOCK_TAGS and not self.tables:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.skip:
            return
        if self.cell is not None:
            self.cell.append(data)
        elif not self.tables and data.strip():
            self.parts.append(data)


def _plain(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "".join(parser.parts)


def _plain_series(html: pd.Series) -> pd.Series:
    return html.map(_plain)


def tidy(text: Column) -> Column:
    """Single spaces, no spaces at line ends, at most one blank line."""
    out = F.regexp_replace(text, "[ \t]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, " *\n *", "\n"), "\n{3,}", "\n\n")
    return F.trim(out, F.lit(" \n\t\r"))


def html_to_text(html: Column | str) -> Column:
    """Readable text of a page: tags are parsed in Python, spacing in Spark."""
    parse = F.pandas_udf(_plain_series, "string")
    return tidy(parse(html))


def clean_text(text: Column | str) -> Column:
    """Final spacing and left-over entities of filing text."""
    out = F.col(text) if isinstance(text, str) else text
    out = F.regexp_replace(out, "[ \t]+\n", "\n")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&#160;", " "), ("\u00a0", " ")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(out, " {3,}", "  ")


def is_signature_block(text: Column) -> Column:
    """Signature pages: a marker phrase, or three signed names."""
    head = F.lower(text)
    marker = (
        head.contains("power of attorney") | head.contains("know all persons by these presents")
        | head.contains("pursuant to the requirements of the securities exchange act of 1934, this report has been signed")
    )
    names = F.regexp_count(text, F.lit(r"/s/\s*[A-Z][a-z]+"))
    return (F.length(F.trim(text)) >= 100) & (marker | (names >= 3))


def event_item(text: Column, item: str) -> Column:
    """The body of one numbered item of a short filing."""
    number = re.search(r"\d+\.\d+", item)
    if not number:
        raise ValueError(f"{item!r} names no item")
    found = F.regexp_extract(
        text, rf"(?is)item\s*{re.escape(number.group())}[.:\s]*(.*?)(?=item\s*\d+\.\d+|signature)", 1
    )
    body = F.trim(found, F.lit(" \n\t\r"))
    return F.when(body != "", body)


def listed_items(description: Column) -> Column:
    """Item numbers named in a filing's description."""
    return F.regexp_extract_all(description, F.lit(r"(\d+\.\d{2})"), F.lit(1))


# Search.

def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def containing(names: DataFrame, name: str, parts: DataFrame, part: str) -> DataFrame:
    """Pairs in which ``name`` contains ``part``; an empty part is in nothing.

    An equi-join on a run of up to three characters: every such run of a name
    meets the parts that begin with it, at its place, and only those are
    compared. A pair is found at the first place at which the part stands.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1)))
    placed = names.select("*", F.explode(starts).alias("__at"))
    runs = F.array(*[F.substring(F.col(name), F.col("__at"), F.lit(k)) for k in (1, 2, 3)])
    # At the end of a name its shorter runs are the same.
    keyed = placed.select("*", F.posexplode(runs).alias("__k", "__run")).where(F.length("__run") > F.col("__k")).drop("__k")
    sought = parts.where(F.length(part) > 0).withColumn("__run", F.substring(part, 1, 3))
    return keyed.join(sought, "__run").where(F.instr(F.col(name), F.col(part)) == F.col("__at")).drop("__run", "__at")


# Windows of 1, 2 and 4 pieces are hashed at every place of a text.
_LEVELS = 3
# What is sought in the texts is sent to every task up to this many rows, about 20 MB.
_BROADCAST_ROWS = 200_000
# Different phrases of up to three letters that are sought in each text directly; more go through the vocabulary.
_NEEDLES = 200


def _spaced(text: Column) -> Column:
    """Words with the white space behind them; put together they are the text."""
    return F.split(F.lower(text), r"(?<=\s)(?=\S)")


def _with_windows(df: DataFrame, pieces: str) -> DataFrame:
    """Add ``__h0``, ``__h1`` and so on: hashes of all windows, each level made of two windows of the one before."""
    df = df.withColumn("__h0", F.transform(pieces, lambda w: F.xxhash64(w)))
    none = F.array().cast("array<bigint>")

    def doubled(below: str, half: int) -> Column:
        made = F.transform(
            F.sequence(F.lit(1), F.size(below) - half), lambda i: F.xxhash64(F.element_at(below, i), F.element_at(below, i + half))
        )
        return F.when(F.size(below) > half, made).otherwise(none)

    for level in range(1, _LEVELS):
        df = df.withColumn(f"__h{level}", doubled(f"__h{level - 1}", 1 << (level - 1)))
    return df


def _hashed_side(found: DataFrame) -> DataFrame:
    """The side of a join with texts that is hashed; by the size of their file texts would pass for small, whatever comes of them."""
    return F.broadcast(found) if found.count() <= _BROADCAST_ROWS else found.hint("shuffle_hash")


def phrase_search(docs: DataFrame, phrases: DataFrame, doc: str = "doc_id", phrase_id: str = "item_id") -> DataFrame:
    """Documents that contain each phrase, ignoring case, white space as written.

    The first and last piece of a phrase may be cut in the text, its inner
    pieces must stand there whole. A text lists the hashes of all windows of 1, 2
    and 4 pieces with their place and both neighbours; a phrase's inner
    pieces are covered by a few windows of the largest size that fits. Windows
    meet in an equi-join on the hash, end pieces are held against the
    neighbours, and places at which all windows of a phrase stand in line are
    hits. So a frequent word leads nowhere on its own, and only windows that a
    phrase has too are shuffled, no texts. Equality of inner pieces is that of
    64-bit hashes.

    Phrases without an inner piece go through the vocabulary: pieces of texts
    that contain the phrase's longer piece; a few of up to three letters are
    sought in the texts. Blank phrases match nothing.
    """
    p = phrases.select(phrase_id, F.lower("phrase").alias("phrase")).where(F.trim("phrase", F.lit(" \n\t\r")) != "")
    p = p.withColumn("__p", _spaced(F.col("phrase"))).withColumn("__inner", F.size("__p") - 2)
    d = docs.where("text IS NOT NULL").select(doc, F.monotonically_increasing_id().alias("__row"), _spaced(F.col("text")).alias("__t"))

    long = _with_windows(p.where("__inner > 0").withColumn("__t", F.slice("__p", 2, F.col("__inner"))), "__t")
    level = F.least(F.floor(F.log2("__inner")), F.lit(_LEVELS - 1)).cast("int")
    long = long.withColumn("level", level).withColumn("__span", F.call_function("shiftleft", F.lit(1), "level"))
    last = F.col("__inner") - F.col("__span")
    offsets = F.array_distinct(F.array_append(F.sequence(F.lit(0), last, F.col("__span")), last))
    hashes = F.element_at(F.array(*[F.col(f"__h{m}") for m in range(_LEVELS)]), F.col("level") + 1)
    sought = long.select(
        phrase_id, "level", last.alias("__last"), F.size(offsets).alias("__windows"), F.explode(offsets).alias("offset"), hashes.alias("__h"),
        F.element_at("__p", 1).alias("__head"), F.element_at("__p", -1).alias("__tail"),
    )
    sought = sought.withColumn("hash", F.element_at("__h", F.col("offset") + 1)).drop("__h")

    # All levels in one list of hashes; a place in it gives level and place in the text, and from those the neighbours.
    many = [F.greatest(F.size("__t") - (1 << m) + 1, F.lit(0)) for m in range(_LEVELS)]
    listed = _with_windows(d, "__t").select(
        doc, "__row", "__t", *[F.lit(0).alias("__s0") if m == 0 else sum(many[1:m], many[0]).alias(f"__s{m}") for m in range(_LEVELS)],
        F.posexplode(F.concat(*[F.col(f"__h{m}") for m in range(_LEVELS)])).alias("__p", "hash"),
    )
    level, start = F.lit(0), F.col("__s0")
    for m in range(1, _LEVELS):
        level, start = F.when(F.col("__p") >= F.col(f"__s{m}"), m).otherwise(level), F.when(F.col("__p") >= F.col(f"__s{m}"), F.col(f"__s{m}")).otherwise(start)
    placed = listed.select(doc, "__row", "__t", "hash", level.alias("level"), (F.col("__p") - start).alias("at"))
    after = F.get("__t", F.col("at") + F.call_function("shiftleft", F.lit(1), "level"))
    windows = placed.select(doc, "__row", "level", "at", "hash", F.get("__t", F.col("at") - 1).alias("before"), after.alias("after"))
    met = windows.join(_hashed_side(sought), ["level", "hash"])
    met = met.where(((F.col("offset") > 0) | F.endswith("before", "__head")) & ((F.col("offset") < F.col("__last")) | F.startswith("after", "__tail")))
    places = met.groupBy(doc, "__row", phrase_id, (F.col("at") - F.col("offset")).alias("start")).agg(F.count("*").alias("n"), F.first("__windows").alias("of"))
    found = places.where("n = of").select(doc, phrase_id).distinct()

    short = p.where("__inner <= 0")
    if short.isEmpty():
        return found
    pieces = F.transform("__p", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    short = short.select(phrase_id, F.get("__p", F.lit(0)).alias("__head"), F.get("__p", F.lit(1)).alias("__tail"), F.array_max(pieces)["w"].alias("__piece"))
    # A text has one piece at least; the outer form keeps Spark from splitting it again in filters for empty lists.
    each = d.select(doc, "__t", F.posexplode_outer("__t").alias("__at", "piece"))
    each = each.select(doc, "piece", F.get("__t", F.col("__at") - 1).alias("before"), F.get("__t", F.col("__at") + 1).alias("after"))
    # Up to three letters stand in most of the vocabulary: a few of them are sought in the texts themselves.
    tiny = F.col("__tail").isNull() & (F.length("__piece") <= 3)
    needles = [r["__piece"] for r in short.where(tiny).select("__piece").distinct().limit(_NEEDLES + 1).collect()]
    if 0 < len(needles) <= _NEEDLES:
        low = docs.where("text IS NOT NULL").select(doc, F.lower("text").alias("__low"))
        held = low.select(doc, F.array_compact(F.array(*[F.when(F.contains("__low", F.lit(w)), F.lit(w)) for w in needles])).alias("__held"))
        held = held.select(doc, F.explode_outer("__held").alias("__piece"))
        found = found.unionByName(held.join(_hashed_side(short.where(tiny)), "__piece").select(doc, phrase_id).distinct())
        short = short.where(~tiny)

    head, tail = F.col("__head"), F.col("__tail")
    ensure_checkpoint_dir(docs.sparkSession)
    led = containing(each.select("piece").distinct(), "piece", short, "__piece")
    led = led.where(tail.isNull() | F.endswith("piece", head) | F.startswith("piece", tail)).checkpoint()
    fits = (
        tail.isNull() | (F.endswith("piece", head) & F.startswith("after", tail)) | (F.startswith("piece", tail) & F.endswith("before", head))
    )
    return found.unionByName(each.join(_hashed_side(led), "piece").where(fits).select(doc, phrase_id).distinct())


# How an executive is named next to the title, in order of preference.
CHIEF_PATTERNS = (
    r"Chief Executive Officer[,\s\-—]+([A-Z][a-z]+\s+(?:[A-Z]\.?\s+)?[A-Z][a-z]+)",
    r"([A-Z][a-z]+\s+(?:[A-Z]\.?\s+)?[A-Z][a-z]+)[,\s\-—]+Chief Executive Officer",
    r"CEO[,\s\-—]+([A-Z][a-z]+\s+(?:[A-Z]\.?\s+)?[A-Z][a-z]+)",
    r"([A-Z][a-z]+\s+(?:[A-Z]\.?\s+)?[A-Z][a-z]+)[,\s\-—]+CEO",
)


def chief_executive(text: Column | str) -> Column:
    """The first name next to the title anywhere in a filing's text, NULL without one."""
    found = [F.regexp_extract(text, pattern, 1) for pattern in CHIEF_PATTERNS]
    return F.coalesce(*[F.when(name != "", F.trim(name)) for name in found])


def signed_by(docs: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(key, signer, title): signatures of a filing, each with the title in one of the next three lines.

    A signature is a line with ``/s/`` and a name of two or more words; its
    title is the first of the lines below, up to the next signature, that holds
    an office. Works on the lines of a row, without any shuffle.
    """
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    df = docs.where(F.col("text").contains("/s/")).select(*key, lines.alias("__l"))
    name = lambda line: F.regexp_extract(line, r"/s/\s*([A-Z][A-Za-z.'\-]*(?:\s+[A-Z][A-Za-z.'\-]*)+)", 1)
    signed = F.transform("__l", lambda line, i: F.struct(name(line).alias("signer"), i.alias("i")))
    df = df.select(*key, "__l", F.inline(F.filter(signed, lambda x: x["signer"] != "")))
    below = F.slice("__l", F.col("i") + 2, 3)
    offices = F.transform(below, lambda line: F.when(line.contains("/s/"), F.lit("/s/")).when(line.rlike(OFFICES), line))
    first = F.try_element_at(F.array_compact(offices), F.lit(1))
    return df.select(*key, "signer", F.when(first != "/s/", first).alias("title"))


# Words that make a line below a signature a title.
OFFICES = r"(?i)\b(?:chief|president|director|treasurer|controller|secretary|chair(?:man|woman|person)?|officer)\b"


# Paragraph diff.

def paragraphs(docs: DataFrame, key: Sequence[str], separator: str = "\n\n") -> DataFrame:
    """Paragraphs under a digest of their normalised text; the last of a kind stays."""
    rows = docs.select(*key, F.posexplode(F.split("text", separator)).alias("pos", "para"))
    norm = F.sha2(F.lower(F.trim(F.regexp_replace("para", r"\s+", " "))), 256)
    rows = rows.where(F.trim("para", F.lit(" \n\t\r")) != "").withColumn("para_key", norm)
    return rows.groupBy(*key, "para_key").agg(
        F.max_by("para", "pos").alias("para"), F.min("pos").alias("pos")
    )


def diff_sections(
    old: DataFrame, new: DataFrame, key: Sequence[str], separator: str = "\n\n"
) -> DataFrame:
    """Added and removed paragraphs between two versions of a text, all of them and whole.

    ``old`` and ``new`` have the key columns and ``text``.
    """
    a = paragraphs(old, key, separator).select(*key, "para_key", F.col("para").alias("a"), F.col("pos").alias("ap"))
    b = paragraphs(new, key, separator).select(*key, "para_key", F.col("para").alias("b"), F.col("pos").alias("bp"))
    both = a.join(b, [*key, "para_key"], "full_outer")
    added = F.when(F.col("a").isNull(), F.struct(F.col("bp"), F.col("b")))
    removed = F.when(F.col("b").isNull(), F.struct(F.col("ap"), F.col("a")))

    def text(c: str, field: str) -> Column:
        return F.array_join(F.transform(c, lambda x: x[field]), "\n\n")

    changes = both.groupBy(*key).agg(
        F.array_sort(F.collect_list(added)).alias("__add"), F.array_sort(F.collect_list(removed)).alias("__rem")
    )
    sizes = old.select(*key, F.length("text").alias("__old")).join(
        new.select(*key, F.length("text").alias("__new")), list(key)
    )
    out = sizes.join(changes, list(key), "left")
    n_add = F.coalesce(F.size("__add"), F.lit(0))
    n_rem = F.coalesce(F.size("__rem"), F.lit(0))
    change = F.col("__new") - F.col("__old")
    size = F.format_number(F.abs(change), 0)
    summary = (
        F.when(change > 0, F.concat(F.lit("Section expanded by "), size, F.lit(" chars ("), n_add, F.lit(" new paragraphs, "), n_rem, F.lit(" removed).")))
        .when(change < 0, F.concat(F.lit("Section contracted by "), size, F.lit(" chars ("), n_add, F.lit(" new, "), n_rem, F.lit(" removed).")))
        .otherwise(F.concat(F.lit("Section length unchanged ("), n_add, F.lit(" added, "), n_rem, F.lit(" removed).")))
    )
    return out.select(
        *key, n_add.alias("n_added"), n_rem.alias("n_removed"), change.alias("length_change"),
        text("__add", "b").alias("added_text"), text("__rem", "a").alias("removed_text"), summary.alias("summary"),
    )


# Phrases that point to the proxy statement.
PROXY_PHRASES = ("proxy statement", "definitive proxy", "def 14a", "incorporated by reference", "annual meeting")


def proxy_fallback(sections: DataFrame, proxies: DataFrame, key: str = "cik", short: int = 3000) -> DataFrame:
    """Short sections that point to the proxy statement take its newest text if longer.

    ``sections`` is (key, text) and ``proxies`` (key, filed, proxy_text).
    """
    newest = proxies.groupBy(key).agg(F.max_by(F.struct("filed", "proxy_text"), F.struct("filed", "proxy_text")).alias("p"))
    out = sections.join(newest, key, "left")
    low = F.lower("text")
    points = F.exists(F.array(*[F.lit(w) for w in PROXY_PHRASES]), lambda w: low.contains(w))
    trimmed = F.length(F.trim("text", F.lit(" \n\t\r")))
    longer = F.length(F.trim("p.proxy_text", F.lit(" \n\t\r"))) > trimmed
    swap = F.coalesce((trimmed < short) & points & longer, F.lit(False))
    note = F.concat(F.lit("[From the proxy statement filed "), F.col("p.filed").cast("string"), F.lit("]\n\n"), F.col("p.proxy_text"))
    return out.select(
        *[c for c in sections.columns if c != "text"], F.when(swap, note).otherwise(F.col("text")).alias("text"),
        swap.alias("from_proxy"),
    )


# Chunks, entities, labels.

def chunk_text(docs: DataFrame, size: int = 512, overlap: int = 128, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Overlapping runs of words; a short text is one chunk, unchanged."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below the chunk size")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    df = docs.where(F.trim("text", F.lit(" \n\t\r")) != "").withColumn("__w", words)
    step, n = size - overlap, F.size("__w")
    # Chunks start every step until one reaches the end.
    last = F.greatest(F.ceil((n - size) / F.lit(step)).cast("int"), F.lit(0))
    starts = F.transform(F.sequence(F.lit(0), last), lambda k: k * step)
    chunks = F.transform(starts, lambda s: F.array_join(F.slice("__w", s + 1, size), " "))
    chunks = F.when(n <= size, F.array("text")).otherwise(chunks)
    return df.select(*key, F.posexplode(chunks).alias("chunk_no", "chunk"))


# Entity patterns.
ENTITY_PATTERNS = {
    "MONEY": r"(?i)\$[\d,]+(?:\.\d+)?(?:\s*(?:million|billion|thousand|mn|bn|k))?",
    "PERCENT": r"\d+\.?\d*\s*%",
    "DATE": (
        r"(?i)(?:Q[1-4]\s*\d{4}|fiscal\s+year\s+\d{4}|FY\s*\d{2,4}|(?:January|February|March|April|May|June|July|"
        r"August|September|October|November|December)\s+\d{1,2},?\s+\d{4})"
    ),
}


def entities(docs: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Money, percent and date mentions, one row each, score one."""
    def mentions(label: str, pattern: str) -> Column:
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        return F.transform(hits, lambda x: F.struct(F.lit(label).alias("label"), F.trim(x).alias("entity")))

    found = F.concat(*[mentions(n, p) for n, p in ENTITY_PATTERNS.items()])
    return docs.select(*key, F.explode(found).alias("e")).select(*key, "e.*", F.lit(1.0).alias("score"))


def entity_counts(found: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Distinct entities per label."""
    return found.select(*key, "label", "entity").distinct().groupBy(*key, "label").agg(F.count("*").alias("n"))


def weighted_labels(chunks: DataFrame, labels: Sequence[str], key: Sequence[str] = ("doc_id",), weight: str = "weight") -> DataFrame:
    """Length-weighted mean score per label and the leading label.

    Without any weight the result is neutral with score zero.
    """
    total = F.sum(F.col(weight).cast("decimal(28,4)"))
    aggs = [
        safe_div(F.sum((F.col(n) * F.col(weight)).cast("decimal(28,6)")), total).alias(n) for n in labels
    ]
    out = chunks.groupBy(*key).agg(*aggs)
    # The first label wins a tie.
    options = F.array(*[F.struct(F.coalesce(n, F.lit(0.0)).alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("l")) for i, n in enumerate(labels)])
    best = F.array_max(options)
    known = F.coalesce(*[F.col(n) for n in labels]).isNotNull()
    return out.withColumns({
        "label": F.when(known, best["l"]).otherwise("neutral"), "score": F.when(known, best["s"]).otherwise(0.0),
    })


def score_chunks(chunks: DataFrame, model: Callable[[pd.Series], pd.DataFrame], schema: str, text: str = "chunk") -> DataFrame:
    """Run a model over chunks in batches; its columns are added to each row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = model(pdf[text])
            yield pd.concat([pdf.reset_index(drop=True), scores.reset_index(drop=True)], axis=1)

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return chunks.mapInPandas(run, f"{base}, {schema}")


def last_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last n turns per conversation, then user and assistant turns with text."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    recent = turns.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
    said = F.trim(F.coalesce("text", F.lit("")), F.lit(" \n\t\r")) != ""
    return recent.where(F.col("role").isin("user", "assistant") & said)


# Sections by page anchor.

class _Marked(HTMLParser):
    """The page's text pieces in order, each with the anchors opened since the one before."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[tuple[str, list[str]]] = []
        self.names: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.names += [v for k, v in attrs if k in ("id", "name") and v]

    def handle_data(self, data):
        if data.strip():
            self.pieces.append((data.strip(), self.names))
            self.names = []


def _pieces(html: pd.Series) -> pd.Series:
    def one(page):
        parser = _Marked()
        parser.feed(page or "")
        parser.close()
        return [{"text": t, "names": n} for t, n in parser.pieces]

    return html.map(one)


def anchored_section(html: Column | str, item: str) -> Column:
    """Text from the last place that names the item, up to the next item's heading.

    A place names the item if an anchor opened before it holds the item's
    number, or if a heading of under 120 characters says "item" and it. The
    parser only splits the page; start and end are found in the pieces. NULL
    where the item is not named.
    """
    pieces = F.pandas_udf(_pieces, "array<struct<text:string,names:array<string>>>")(html)
    label, bare = f"item {item}".lower(), item.replace(" ", "").lower()

    def names_it(p: Column) -> Column:
        plain = F.transform(p["names"], lambda n: F.regexp_replace(F.lower(n), "[ _]", ""))
        return F.exists(plain, lambda n: n.contains(bare)) | (
            (F.length(p["text"]) < 120) & F.lower(p["text"]).contains(label)
        )

    def other(p: Column) -> Column:
        return p["text"].rlike(r"(?i)^item\s+\d+[a-z]*[.\s:\-]") & ~F.lower(p["text"]).startswith(label)

    def section(all_: Column) -> Column:
        start = F.array_max(F.transform(all_, lambda p, i: F.when(names_it(p), i)))
        rest = F.slice(all_, start + 1, F.size(all_))
        stop = F.array_min(F.transform(rest, lambda p, i: F.when((i > 0) & other(p), i)))
        kept = F.slice(rest, 1, F.coalesce(stop, F.size(rest)))
        return F.when(start.isNotNull(), F.array_join(F.transform(kept, lambda p: p["text"]), "\n"))

    return F.element_at(F.transform(F.array(pieces), section), 1)
