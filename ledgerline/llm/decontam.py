"""Test items inside long documents by size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import WORDLIKE, cut, lowered

WORDS = 5
CONTAINED = 0.8
HASHES = 96
# Windows of the smallest size class advance by this many shingles.
STEP = 8
# Items per pass over the documents: their signatures, at most 96 numbers each, go to every task.
ITEMS = 8192
# Items of up to so many shingles are sought by shingles themselves.
SMALL = 8
_EXACT = 255
# Text that a task works on at once.
_CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
_ODD = (np.random.default_rng(7).integers(1, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def shingle_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the word shingles of several texts, and how many each text has.

    A text of fewer words has its whole sequence as one shingle, one without
    words has none. Sums of bytes times powers of an odd base give the hash of
    any stretch by one subtraction.
    """
    split = [t.translate(_FOLD).split() for t in texts]
    counts = np.array([len(s) for s in split])
    lengths = np.fromiter((len(w) for s in split for w in s), np.int64, counts.sum())
    data = np.frombuffer(b" ".join(b" ".join(s) for s in split if s), np.uint8)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    made = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    first_word = np.cumsum(counts) - counts
    first_made = np.cumsum(made) - made
    text = np.repeat(np.arange(len(texts)), made)
    a = first_word[text] + np.arange(made.sum()) - first_made[text]
    z = a + np.minimum(words, counts)[text] - 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _BASE, np.uint64)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
        # Compared at a common power: each stretch is shifted up to the end of the data.
        h = (sums[ends[z]] - sums[starts[a]]) * power[len(data) - starts[a]]
        # Undo the length of this batch, so that equal shingles of any batch get equal hashes.
        h *= np.uint64(pow(pow(_BASE, len(data), 1 << 64), -1, 1 << 64))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32), made


def size_class(shingles: int) -> int:
    """The class whose windows hold any run of so many shingles: step STEP * 2**class, twice as wide."""
    return max(0, ceil(np.log2(max(shingles, 1) / STEP)))


def _key(level: int, i: np.ndarray | int, value: np.ndarray) -> np.ndarray:
    return (np.uint64(level) << np.uint64(40)) | (np.uint64(i) << np.uint64(32)) | value.astype(np.uint64)


def _item_signatures(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        hashes, made = shingle_hashes([t.encode("utf-8", "surrogatepass") for t in batch["text"]], WORDS)
        ends = np.cumsum(made)
        rows = []
        for item, a, b in zip(batch["no"], ends - made, ends, strict=True):
            if b > a:
                own = np.unique(hashes[a:b])
                if len(own) <= SMALL:
                    # Of any so many shingles, a text that holds the share holds one at least.
                    need = len(own) - ceil(threshold * len(own) - 1e-9) + 1
                    keys = _key(_EXACT, 0, own[: min(need, len(own))])
                else:
                    keys = _key(size_class(len(own)), np.arange(HASHES), (own[:, None] * _ODD[None, :]).min(axis=0))
                rows.append((item, keys.astype(np.int64).tolist()))
        yield pd.DataFrame(rows, columns=["no", "keys"])


def window_hits(texts: list[bytes], wanted: np.ndarray) -> list[np.ndarray]:
    """Per text, the wanted signature values that the windows of a size class attain."""
    hashes, made = shingle_hashes(texts, WORDS)
    found: list[list] = [[] for _ in texts]
    if not len(hashes) or not len(wanted):
        return [np.zeros(0, np.uint64) for _ in texts]
    exact = wanted >> np.uint64(40) == np.uint64(_EXACT)
    if exact.any():
        sought = np.sort(wanted[exact] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at = np.minimum(np.searchsorted(sought, hashes), len(sought) - 1)
        owner = np.repeat(np.arange(len(texts)), made)
        for j in np.flatnonzero(sought[at] == hashes):
            found[owner[j]].append(int(_key(_EXACT, 0, hashes[j : j + 1])[0]))
    wanted = wanted[~exact]
    if not len(wanted):
        return [np.unique(np.array(f, np.uint64)) for f in found]
    levels = np.unique(wanted >> np.uint64(40)).astype(int)
    per = [-(-made // (STEP << k)) for k in range(levels.max() + 1)]
    # Blocks never cross texts: starts of the smallest blocks, then of pairs of blocks, and so on.
    first = np.cumsum(made) - made
    text = [np.repeat(np.arange(len(texts)), n) for n in per]
    inner = [np.arange(n.sum()) - (np.cumsum(n) - n)[t] for n, t in zip(per, text, strict=True)]
    base = first[text[0]] + inner[0] * STEP
    pairs = [np.flatnonzero(inner[k] % 2 == 0) for k in range(len(per) - 1)]
    joins = [np.append(t[1:] == t[:-1], False) for t in text]
    by = {(k, i): np.sort(wanted[(wanted >> np.uint64(32)) == np.uint64(k << 8 | i)] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
          for k in levels for i in range(HASHES)}
    for i in range(HASHES):
        low = np.minimum.reduceat(hashes * _ODD[i], base)
        for k in range(len(per)):
            if k:
                low = np.minimum.reduceat(low, pairs[k - 1])
            if (k, i) in by and len(by[k, i]):
                wide = np.minimum(low, np.where(joins[k], np.append(low[1:], low[-1]), low))
                sought = by[k, i]
                at = np.minimum(np.searchsorted(sought, wide), len(sought) - 1)
                for j in np.flatnonzero(sought[at] == wide):
                    found[text[k][j]].append(int(_key(k, i, wide[j : j + 1])[0]))
    return [np.unique(np.array(f, np.uint64)) for f in found]


def _candidates(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Documents (id, text) of which a window shares a signature value with an item, with those values."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [t.encode("utf-8", "surrogatepass") for t in batch["text"]]
            sizes = np.cumsum([0, *map(len, data)])
            at = 0
            while at < len(data):
                to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + _CHUNK, "right")) - 1)
                hits = window_hits(data[at:to], wanted)
                some = [k for k, h in enumerate(hits) if len(h)]
                if some:
                    out = batch.iloc[[at + k for k in some]].copy()
                    out["keys"] = [hits[k].astype(np.int64).tolist() for k in some]
                    yield out
                at = to

    return docs.mapInPandas(search, "id string, text string, keys array<long>")


def shingles(text: Column, words: int = WORDS) -> Column:
    """Distinct word shingles of a text as strings, natively."""
    tokens = F.regexp_extract_all(lowered(text), F.lit(WORDLIKE), F.lit(0))

    def made(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - words + 1, F.lit(1)))
        parts = F.transform(starts, lambda i: F.array_join(F.slice(t, i, words), " "))
        return F.when(F.size(t) > 0, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))

    # Bound once: inside a lambda the split would be done again for every shingle.
    return F.element_at(F.transform(F.array(tokens), made), 1)


def contained(docs: DataFrame, items: DataFrame, threshold: float = CONTAINED, id: str = "doc_id", text: str = "text",
              item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (id, item, containment): the share of an item's word shingles found in a document, from ``threshold``.

    Items are partitioned by size. For an item of more than eight and up to s
    shingles a document is looked at in windows of 2 s shingles every s, so item
    and window are of like size however long the document; they meet if one of
    96 minima agrees. What a window shares with the item agrees in each minimum
    with the probability of their resemblance; over all windows the expected
    number of agreements of a pair is 96 * 0.8 / 5 or more wherever the shared
    shingles lie, so a pair is missed with a probability near 1e-6. Smaller
    items are sought by hashes of their own shingles, as many as make sure that
    one is met, and none is missed. All pairs that meet are verified by the
    exact containment of the shingle strings over the whole document.

    Signatures of at most 8,192 items go to the tasks per pass over the
    documents; more items take more passes. Only documents with a hit (and
    their texts) leave the first stage. NULL texts are empty; a text of fewer
    than five words has its whole sequence as its only shingle; one without
    words matches nothing; a repeated document, or item, counts once, a NULL id
    or item like any other; no rows give no rows.
    """
    slim = docs.select(F.col(id).cast("string").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    tests = items.select(F.col(item).alias("item"), F.coalesce(item_text, F.lit("")).alias("text")).distinct()
    # Numbers stand for items: a NULL one joins like any other.
    tests = cut(tests.withColumn("no", F.monotonically_increasing_id()))
    signed = cut(tests.select("no", "text").mapInPandas(lambda batches: _item_signatures(batches, threshold), "no long, keys array<long>"))
    passes = max(1, ceil(signed.count() / ITEMS))
    pairs = None
    for p in range(passes):
        own = signed.where(F.pmod(F.xxhash64("no"), F.lit(passes)) == p).select("no", F.explode("keys").alias("key"))
        wanted = np.array([r["key"] for r in own.select("key").distinct().collect()], np.int64).astype(np.uint64)
        hit = cut(_candidates(slim, wanted)).withColumn("row", F.monotonically_increasing_id())
        met = hit.select("row", F.explode("keys").alias("key")).join(own, "key").select("row", "no").distinct()
        sought = tests.select("no", shingles(F.col("text")).alias("parts")).withColumn("n", F.size("parts"))
        sought = sought.select("no", "n", F.explode("parts").alias("part"))
        # A text's shingles only meet those of the items it was found by.
        held = hit.select("row", "id", F.explode(shingles(F.col("text"))).alias("part")).join(met, "row")
        shared = held.join(sought, ["no", "part"]).groupBy("row", "id", "no", "n").agg(F.count("*").alias("shared"))
        sure = shared.where(F.col("shared") / F.col("n") >= threshold).join(tests.select("no", "item"), "no")
        found = sure.select("id", "item", (F.col("shared") / F.col("n")).alias("containment"))
        pairs = found if pairs is None else pairs.union(found)
    best = pairs.groupBy("id", "item").agg(F.max("containment").alias("containment"))
    return best.select(F.col("id").cast(dict(docs.dtypes)[id]).alias(id), F.col("item").alias(item), "containment")


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '{WORDLIKE}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '{WORDLIKE}') AS ws FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {WORDS - 1}], ' ') AS part
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 2}, 2))) AS i FROM d WHERE len(ws) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + {WORDS - 1}], ' ') AS part
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 2}, 2))) AS i FROM b WHERE len(ws) > 0)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) / any_value(n) AS containment
FROM ds JOIN bs USING (part) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) / any_value(n) >= {CONTAINED}
"""
