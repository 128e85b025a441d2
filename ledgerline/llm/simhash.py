"""Near-duplicate texts by SimHash fingerprints and per-segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, runs, written
from ledgerline.llm.components import components

SEED = 42
# Fingerprints per grid cell above which the cell is searched by neighbour values.
CROWDED = 64
_EVEN = 0x5555555555555555
_BLOCK = 1 << 15


def fingerprint(text: str | None, words: int) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included, as a signed number."""
    if not text:
        return 0
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        part = zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts))
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text") -> Column:
    """Column with the fingerprint of a whole text; A-Z are lower-cased, no words give zero."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, words) for x in texts], dtype="int64")

    return of(docs[text])


def embedding(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, each written in unary (00, 01, 11).

    In unary the Manhattan distance of two vectors of counts is the number of
    differing bits. It never exceeds the distance of the fingerprints.
    """
    next_bit = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(next_bit).bitwiseAND(F.lit(_EVEN))
    both = fp.bitwiseAND(next_bit).bitwiseAND(F.lit(_EVEN))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(radius: int) -> list[int]:
    """Cells: the segments fall into radius + 2 bands, of which two must agree whole."""
    bands = radius + 2
    cuts = [round(32 * i / bands) * 2 for i in range(bands + 1)]
    band = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [_signed(x | y) for x, y in combinations(band, 2)]


def _neighbours(fp: Column, radius: int) -> Column:
    """All values within ``radius`` bits of a fingerprint, itself included."""
    flips = [0]
    for k in range(1, radius + 1):
        flips += [_signed(sum(1 << b for b in bits)) for bits in combinations(range(64), k)]
    return F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: fp.bitwiseXOR(x))


def links(fps: DataFrame, radius: int = 2, crowded: int = CROWDED) -> DataFrame:
    """Edges (a, b) that connect all distinct values of ``fp`` within ``radius`` bits.

    Values are mapped to per-segment bit counts. If two vectors of counts are
    within ``radius`` in Manhattan distance, at least two of radius + 2 bands of
    segments agree whole, so an equi-join on pairs of bands (the cells of a
    grid) meets every such pair; the Manhattan distance and then the exact
    distance decide. A cell with more than ``crowded`` values, such as one full
    of near copies, is not paired with itself: its values are listed under all
    values half the radius away, where any two in reach meet at least once and
    any that meet are in reach, and linked to the smallest there. Both ways are
    exact and cost a fixed number of rows per value. ``radius`` must be even.
    """
    if radius % 2 or radius < 0:
        raise ValueError("radius must be even")
    masks = _masks(radius)
    fps = fps.select("fp", embedding(F.col("fp")).alias("counts"))
    cells = fps.select(
        "fp", "counts", F.posexplode(F.array(*[F.col("counts").bitwiseAND(F.lit(m)) for m in masks])).alias("grid", "cell")
    )
    sizes = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    filled = cut(cells.join(sizes, ["grid", "cell"]))
    few = filled.where(F.col("n") <= crowded)
    left = few.select("grid", "cell", F.col("fp").alias("a"), F.col("counts").alias("ca"))
    right = few.select("grid", "cell", F.col("fp").alias("b"), F.col("counts").alias("cb"))
    near = (F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= radius) & (
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    )
    paired = left.join(right, ["grid", "cell"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    many = filled.where(F.col("n") > crowded).select("fp").distinct()
    listed = many.select("fp", F.explode(_neighbours(F.col("fp"), radius // 2)).alias("at"))
    heads = listed.groupBy("at").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    starred = listed.join(heads, "at").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return paired.union(starred).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component) for every row of ``docs``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; the
    component is the smallest id reachable. Equal fingerprints are one node from
    the start, so copies of any number cost one row. Empty and NULL texts have
    fingerprint zero and link like others. Repeated rows stay, each with its
    row. A NULL id takes part in linking but is never the smallest; a component
    of NULL ids alone is NULL. No rows give no rows; further columns are ignored.
    """
    marked = cut(docs.select(F.col(id).alias("id"), fingerprints(docs, words, text).alias("fp")))
    roots = components(links(marked.select("fp").distinct(), radius)).withColumnsRenamed({"node": "fp"})
    firsts = marked.groupBy("fp").agg(F.min("id").alias("first"))
    rooted = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        F.col("id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# Wider reach: similarity of shingle sets instead of two bits.
MINIMA = 256
BLOCK = 2048
# Shingles of a block at most, on average; bands of the first round; texts verified at once.
WEIGHT = 1 << 22
FIRST_BANDS = 4
_STRIP = 32
_PART = 1024
_ODD = (np.random.default_rng(SEED).integers(1, 1 << 32, MINIMA, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_PLACES = np.random.default_rng(SEED + 1).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct word shingles of a text as sorted 64-bit hashes; A-Z are lower-cased.

    A text of fewer words has its whole sequence as one shingle, one without words has none.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    width = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    each = np.fromiter((digest(t, SEED) for t in tokens), np.uint64, len(tokens))
    made = len(tokens) - width + 1
    total = np.full(made, width, np.uint64)
    for k in range(width):
        total += each[k : k + made] * _PLACES[k % len(_PLACES)] + np.uint64(k)
    return np.unique(_mixed(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of a set's shingles under each of 256 hash functions (MinHash)."""
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), _PART):
        np.minimum(low, (_ODD[:, None] * short[None, at : at + _PART]).min(axis=1), out=low)
    return low


def _bits(low: np.ndarray) -> np.ndarray:
    """One hashed bit per minimum, as four numbers: two sets differ in (1 - Jaccard) / 2 of them."""
    h = (low ^ (low >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return np.packbits((h >> np.uint32(31)).astype(np.uint8)).view(np.int64)


def _cell_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One cell per band of ``rows`` minima."""
    parts = low[: bands * rows].astype(np.uint64).reshape(bands, rows)
    return _mixed((parts * _PLACES[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _PLACES[rows]).view(np.int64)


def banding(similarity: float, recall: float) -> tuple[int, int]:
    """(bands, minima a band): sets ``similarity`` alike share a cell with probability ``recall``.

    As many minima a band as the 256 allow, five at most.
    """
    for rows in range(5, 0, -1):
        agree = similarity**rows
        bands = 1 if agree >= 1 else ceil(log(1 - recall) / log(1 - agree))
        if bands * rows <= MINIMA:
            return bands, rows
    raise ValueError("similarity is too small for this recall")


def reach(similarity: float, miss: float = 1e-6) -> int:
    """Bits of 256 within which all but ``miss`` of the pairs with that Jaccard similarity differ (binomial tail)."""
    p = (1 - similarity) / 2
    over, radius = 0.0, MINIMA
    while radius and over + comb(MINIMA, radius) * p**radius * (1 - p) ** (MINIMA - radius) <= miss:
        over += comb(MINIMA, radius) * p**radius * (1 - p) ** (MINIMA - radius)
        radius -= 1
    return radius


def block_edges(left: pd.DataFrame, right: pd.DataFrame | None, radius: int, similarity: float) -> pd.DataFrame:
    """Edges (a, b) that unite all nodes of a block, or of two, that are ``similarity`` alike: a forest, not all pairs.

    Nodes of one root count as united from the start. Pairs of different sets
    whose sizes and hashed bits allow it are tested exactly, nearest bits first,
    until everything left to compare with is of the same set.
    """
    both = left if right is None else pd.concat([left, right], ignore_index=True)
    names, n = both["node"].to_numpy(), both["n"].to_numpy()
    label = np.unique(both["root"].to_numpy(), return_inverse=True)[1]
    bits = np.stack(both["bits"].to_numpy()).astype(np.int64).view(np.uint64)
    sets = [np.frombuffer(x, np.uint64) for x in both["shingles"]]
    edges = []
    for i in range(len(left)):
        start = i + 1 if right is None else len(left)
        apart = np.bitwise_count(bits[start:] ^ bits[i]).sum(axis=1, dtype=np.int64)
        sized = np.minimum(n[start:], n[i]) >= similarity * np.maximum(n[start:], n[i]) - 1e-6
        others = np.flatnonzero((apart <= radius) & sized & (label[start:] != label[i]))
        others = start + others[np.argsort(apart[others], kind="stable")]
        while len(others):
            tried, mine = others[:_STRIP], sets[i]
            values = np.concatenate([sets[j] for j in tried])
            at = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
            common = np.add.reduceat(mine[at] == values, np.cumsum(n[tried]) - n[tried], dtype=np.int64)
            for j in tried[common / (n[i] + n[tried] - common) >= similarity]:
                if label[j] != label[i]:
                    edges.append((names[i], names[j]))
                    label[label == label[j]] = label[i]
            others = others[_STRIP:]
            others = others[label[others] != label[i]]
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 1 - 1e-5, bucket: int = BLOCK,
                   id: str = "doc_id", text: str = "text", near: DataFrame | None = None) -> DataFrame:
    """(id, component) for every row: texts whose sets of word shingles have a Jaccard index from ``similarity`` are linked.

    Candidates come from MinHash and every link is verified by the exact index
    of the two sets (of 64-bit hashes), so nothing less alike is linked. A pair
    at the threshold shares one of the cells (bands of minima) with probability
    ``recall``, more alike pairs sooner. Texts of equal sets are one node, and
    cells of equal nodes one cell.

    ``near`` (id, component_id) names groups found otherwise, such as those of
    :func:`near_duplicates`: each is one more cell, compared with the first, so
    its links are verified like all others.

    The cells of the first few bands come first; in those of the others only
    nodes that are not one component yet are compared. A cell is cut into blocks
    of ``bucket`` nodes, fewer if their texts are long, and each pair of blocks
    is a task that holds the sets and unites what is alike. It reports the edges
    of a forest, so however large a group of near copies is, no more edges than
    nodes leave a task. Pairs are only tested if their sizes and hashed bits
    allow the similarity (all but one in a million at the threshold). Nulls,
    empty texts, repeats and empty tables are as in :func:`near_duplicates`;
    texts without words form one group.
    """
    radius = reach(similarity)
    bands, rows = banding(similarity, recall)

    def node_of(shingles: np.ndarray) -> int:
        return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)

    @F.pandas_udf("node long, n long, bits array<long>, cells array<long>")
    def signed(texts: pd.Series) -> pd.DataFrame:
        out = []
        for x in texts:
            shingles = shingle_set(x, words)
            low = minima(shingles)
            out.append((node_of(shingles), len(shingles), _bits(low).tolist(), _cell_keys(low, bands, rows).tolist() if len(shingles) else []))
        return pd.DataFrame(out, columns=["node", "n", "bits", "cells"])

    @F.pandas_udf("node long, shingles binary")
    def listed(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(x, words) for x in texts]
        return pd.DataFrame({"node": [node_of(x) for x in sets], "shingles": [x.tobytes() for x in sets]})

    marked = cut(docs.select(F.col(id).alias("id"), signed(F.col(text)).alias("s")).select("id", "s.*"))
    nodes = cut(marked.groupBy("node").agg(
        F.min("id").alias("first"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("cells").alias("cells")
    ))
    spread = nodes.select("node", "n", F.posexplode("cells").alias("band", "cell"))
    if near is not None:
        grouped = near.select(F.col(id).alias("near_id"), F.xxhash64("component_id").alias("cell"))
        grouped = marked.join(grouped, F.col("id").eqNullSafe(F.col("near_id"))).where("n > 0")
        spread = cut(spread.union(grouped.select("node", "n", F.lit(-1).alias("band"), "cell").distinct()))
    filled = spread.groupBy("band", "cell").agg(
        F.count("*").alias("held"), F.sum("n").alias("total"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"),
    ).where("held > 1")
    one = F.min(F.struct("band", "cell")).alias("one")
    cells = filled.groupBy("held", "total", "x", "y").agg(one).select("held", "total", "one.*")
    blocks = F.ceil(F.greatest(F.col("held") / bucket, F.col("total") / WEIGHT)).cast("int").alias("blocks")
    members = cut(spread.drop("n").join(cells.select("band", "cell", blocks), ["band", "cell"]))

    # The sets of the nodes that share a cell, made again from one text per node.
    sought = members.select("node").distinct()
    ids = nodes.join(sought, "node", "left_semi").select(F.col("first").alias("id")).distinct()
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    texts = texts.join(ids, texts["id"].eqNullSafe(ids["id"]), "left_semi")
    sets = texts.select(listed(F.col("text")).alias("s")).select("s.*").join(nodes.select("node", "n", "bits"), "node")
    sets = written(sets.join(sought, "node", "left_semi").dropDuplicates(["node"]))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in runs(batches, ["task"]):
            own, i, j = held["own"].to_numpy(), held["i"].iloc[0], held["j"].iloc[0]
            sides = [held[own == i].reset_index(drop=True), None if i == j else held[own == j].reset_index(drop=True)]
            if len(sides[0]) and (i == j or len(sides[1])):
                yield block_edges(*sides, radius, similarity)

    def united(rooted: DataFrame) -> DataFrame:
        """Verified edges (a, b) of the cells of rows (band, cell, node, root, blocks)."""
        own = F.pmod(F.xxhash64(F.lit(2), "node"), F.col("blocks")).cast("int")
        work = rooted.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        i, j = F.least("own", "other"), F.greatest("own", "other")
        work = work.select("node", "root", "own", i.alias("i"), j.alias("j"), F.xxhash64("band", "cell", i, j).alias("task"))
        work = work.join(sets, "node").repartition("task").sortWithinPartitions("task", "node")
        return cut(work.mapInPandas(compare, "a long, b long").distinct())

    first = united(members.where(F.col("band") < FIRST_BANDS).withColumn("root", F.col("node")))
    later = members.where(F.col("band") >= FIRST_BANDS).join(components(first), "node", "left")
    later = cut(later.withColumn("root", F.coalesce("root", "node")))
    apart = later.groupBy("band", "cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    rest = united(later.join(apart.select("band", "cell"), ["band", "cell"], "left_semi"))
    roots = components(first.union(rest))
    rooted = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("node", "component_id")
    return marked.join(named, "node").select(F.col("id").alias(id), "component_id")
