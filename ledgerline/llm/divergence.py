"""How far the sources of a language diverge in their words: dominance skybands of terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, runs, written

# Letters and all bytes of characters outside ASCII; A-Z are lower-cased first.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE = 1_000_000_000
TOP = 200
LEAST_DOCS = 3
# Distinct terms a task counts before it hands them on.
_HELD = 400_000
# Terms of one group that one task merges; more are merged in several rounds.
MERGED = 50_000
# Sources a side of one tile of the matrix of pairs, and tiles a task holds.
_TILE = 256
_TILES = 64
_CELLS = 1 << 20


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per (lang, source, term) of what a task reads."""
    found: dict[tuple, tuple[Counter, Counter]] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in found.items():
            if times:
                n = len(times)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                     pa.array([t.decode("utf-8", "replace") for t in times], pa.string()),
                     pa.array(times.values(), pa.int64()), pa.array([docs[t] for t in times], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
        found.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not text:
                continue
            times, docs = found.setdefault((lang, source), (Counter(), Counter()))
            terms = Counter(_TERM.findall(text.encode("utf-8", "surrogatepass").lower()))
            times.update(terms)
            docs.update(terms.keys())
        if sum(len(t) for t, _ in found.values()) > _HELD:
            yield from emit()
    yield from emit()


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), exact: decimals hold the product."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", top, total.cast("decimal(20,0)"))).cast("long")


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of whole numbers up to 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """:func:`share` of an array of counts, by long division in steps of 1,000, so that no product overflows."""
    value, rest = np.zeros_like(counts), counts + 1
    for _ in range(3):
        rest = rest * 1000
        value = value * 1000 + rest // totals
        rest = rest % totals
    return value + 1


def skyband(group_count: np.ndarray, lang_count: np.ndarray, term: np.ndarray, k: int) -> np.ndarray:
    """Which terms fewer than ``k`` others dominate: at least the group count, at most the lang count, an earlier term.

    Sorted by group count, lang count and term, all dominators of a term come
    before it. It is enough to count them among the terms kept so far: if a
    term has ``k`` dominators, the first ``k`` of them have fewer than ``k``
    themselves, as all theirs are its own too.
    """
    order = np.lexsort((term, lang_count, -group_count))
    low, name = lang_count[order], term[order]
    kept_low, kept_name = np.zeros(0, low.dtype), np.zeros(0, name.dtype)
    keep = np.zeros(len(order), bool)
    for at in range(0, len(order), 256):
        part = slice(at, at + 256)
        a, b = low[part, None], name[part, None]
        over = ((kept_low <= a) & (kept_name < b)).sum(axis=1)
        inside = (low[part] <= a) & (name[part] < b)
        over += np.tril(inside, -1).sum(axis=1)
        stays = over < k
        keep[order[part][stays]] = True
        kept_low = np.concatenate([kept_low, low[part][stays]])
        kept_name = np.concatenate([kept_name, name[part][stays]])
    return keep


def skybands(terms: DataFrame, k: int = TOP) -> DataFrame:
    """Those of ``terms`` (lang, source, term, n, lang_n) that fewer than ``k`` of their group dominate.

    Each partition keeps its own skyband per group; what is left is merged,
    a large group first in salted parts. No task holds a group of any size.
    """

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for one in runs(batches, ["lang", "source", "part"]):
            name = np.unique(one["term"].to_numpy(object), return_inverse=True)[1]
            yield one[skyband(one["n"].to_numpy(), one["lang_n"].to_numpy(), name, k)]

    keys = ["lang", "source", "part"]
    schema = "lang string, source string, part int, term string, n long, lang_n long"
    columns = ["lang", "source", "part", "term", "n", "lang_n"]
    left = terms.withColumn("part", F.lit(0)).select(*columns).sortWithinPartitions(*keys)
    left = cut(left.mapInPandas(bands, schema))
    while True:
        sizes = left.groupBy("lang", "source").agg(F.count("*").alias("held"))
        parts = int(sizes.agg(F.coalesce(F.max(F.ceil(F.col("held") / MERGED)), F.lit(1))).first()[0])
        salted = left.join(sizes, ["lang", "source"]).withColumn("part", F.pmod(F.xxhash64("term"), F.ceil(F.col("held") / MERGED)).cast("int"))
        merged = salted.select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(bands, schema)
        if parts <= 1:
            return merged
        before = left.count()
        left = cut(merged)
        if left.count() > before * 0.9:  # Little is dominated: the exact ranking takes what is left.
            return left


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the excess over a task's terms, per lang and pair of places of its sources."""
    tiles: dict[tuple, np.ndarray] = {}

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, i0, j0), tile in tiles.items():
            i, j = (x.ravel() for x in np.indices(tile.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(i), pa.string()), pa.array(i + i0, pa.int32()), pa.array(j + j0, pa.int32()), pa.array(tile.ravel())],
                names=["lang", "i", "j", "value"],
            )
        tiles.clear()

    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        counts, totals = batch.column("counts"), batch.column("totals")
        at, n = (counts.flatten().field(k).to_numpy() for k in (0, 1))
        owner = np.repeat(np.arange(len(batch)), counts.value_lengths().to_numpy())
        codes = langs.indices.to_numpy()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            rows = np.flatnonzero(codes == code)
            total = np.array(totals[int(rows[0])].as_py(), np.int64)
            size = len(total)
            place = np.full(len(batch), -1)
            place[rows] = np.arange(len(rows))
            step = max(1, _CELLS // max(size, min(size, _TILE) ** 2))
            for a in range(0, len(rows), step):
                inside = (place[owner] >= a) & (place[owner] < a + step)
                held = np.zeros((min(step, len(rows) - a), size), np.int64)
                held[place[owner[inside]] - a, at[inside]] = n[inside]
                p = _shares(held, total[None, :])
                for i in range(0, size, _TILE):
                    for j in range(0, size, _TILE):
                        own, other = p[:, i : i + _TILE, None], p[:, None, j : j + _TILE]
                        added = ((own - other) ** 2 // other).sum(axis=0)
                        if (lang, i, j) in tiles:
                            tiles[lang, i, j] += added
                        else:
                            if len(tiles) == _TILES:
                                yield from emit()
                            tiles[lang, i, j] = added
    yield from emit()


def audit(docs: DataFrame, top: int = TOP, least_docs: int = LEAST_DOCS, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): what sets each source of a language apart.

    A language keeps the terms that at least ``least_docs`` of its documents
    hold. Part ``pair`` compares each (lang, source) with every other source of
    the language over all kept terms. Part ``term`` lists the ``top`` terms
    that the group holds more of, by share, than its language. A term's value
    grows with its count in the group and falls with its count in the language,
    so a term with ``top`` others ahead in both and in name can't rank; each
    partition drops those (:func:`skybands`) before the exact ranking.

    Tasks count words before anything is shuffled, so neither a frequent word
    nor a large source makes a hot key. Pairs are summed per task in tiles of
    the matrix of sources and need no shuffle of terms. A term's row lists its
    sources, and a language's row all of its own; the result has their square
    of rows.

    NULL text, lang and source read as empty. Repeated rows count again. Groups
    without terms still appear in part ``pair`` (value 0 if the language keeps
    none); a language of one source has no pairs. No rows give no rows; other
    columns are ignored.
    """
    given = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = given.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    # One exchange serves both groupings: equal terms of a language lie together.
    by_group = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = by_group.groupBy("lang", "term").agg(
        F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources")
    )
    kept = written(terms.where(F.col("docs") >= least_docs).drop("docs"))
    each = kept.select("lang", "term", "lang_n", F.inline("sources"))

    groups = given.select("lang", "source").distinct()
    sums = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    stats = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    stats = cut(stats.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_total")]))

    shares = (share(F.col("n"), F.col("total") + F.col("v")), share(F.col("lang_n"), F.col("lang_total") + F.col("v")))
    above = each.join(stats, ["lang", "source"]).withColumns({"p": shares[0], "q": shares[1]}).where("p > q")
    best = skybands(above.select("lang", "source", "term", "n", "lang_n"), top).drop("part")
    best = best.join(stats, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess(*shares).alias("value"))

    pairs = _pairs(kept, stats)
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    out = best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return out.union(pairs.withColumn("rank", F.row_number().over(ranked)).select(*out.columns))


def _pairs(kept: DataFrame, stats: DataFrame) -> DataFrame:
    """Part ``pair``: (lang, source, part, item, value) for all pairs of sources of a language."""
    total = (F.col("total") + F.col("v")).alias("total")
    named = stats.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", total))).alias("named"))
    # A row of sources and totals per language; a term's row, compared with all pairs of them, carries it along.
    placed = F.transform("sources", lambda s: F.struct((F.array_position("named.source", s["source"]) - 1).cast("int").alias("at"), s["n"].alias("n")))
    coded = kept.join(named, "lang").select("lang", placed.alias("counts"), F.col("named.total").alias("totals"))
    partial = coded.mapInArrow(_pair_sums, "lang string, i int, j int, value long")
    summed = partial.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    places = named.select("lang", F.posexplode("named.source").alias("at", "source"))
    other = places.select("lang", F.col("at").alias("j"), F.col("source").alias("item"))
    pairs = places.withColumnRenamed("at", "i").join(other, "lang").where("i <> j").join(summed, ["lang", "i", "j"], "left")
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


ORACLE = r"""
WITH g AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM g),
l AS (SELECT lang, term, count(*) AS c FROM w GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN l USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT DISTINCT lang, source FROM g),
t AS (SELECT s.lang, s.source, l.term, coalesce(c.c, 0) AS c, l.c AS lc
      FROM s JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = l.term),
n AS (SELECT lang, source, sum(c) + count(*) AS d, sum(lc) + count(*) AS ld FROM t GROUP BY 1, 2),
p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 1)) // d AS p, 1 + (1000000000::HUGEINT * (lc + 1)) // ld AS q
      FROM t JOIN n USING (lang, source)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y USING (lang, term)
                          WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
         FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
      FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""
