"""Remove byte strings that repeat anywhere, by threshold-bounded expansion on Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import runs, written

LENGTH = 200
GRAM = 50
# Bytes of text a task hashes at once, and bytes of strings from which a transform is closed.
_CHUNK = 1 << 18
_TRANSFORM = 60_000
# Different strings under one key from which their windows are told apart by Spark instead.
CROWDED = 2048
_BASE = 0x9E3779B97F4A7C15
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(values: np.ndarray, width: int, pick: np.ufunc, fill: np.uint64) -> np.ndarray:
    """pick over each window of ``width`` values, by running picks from block starts and block ends."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, fill, np.uint64)
    padded[:n] = values
    table = padded.reshape(rows, width)
    ahead = pick.accumulate(table, axis=1).ravel()
    behind = pick.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


def window_runs(pieces: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows of ``length`` bytes that share their smallest gram hash.

    Returns per run: piece, first window, number of windows, key (that hash),
    content (a hash of all its bytes), and whether the smallest gram stands
    in the piece twice. Equal windows have equal keys wherever they are.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n, width = len(data), length - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n < length:
        return none
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
        level = np.uint64(pow(pow(_BASE, n, 1 << 64), -1, 1 << 64))
        lifted = power[::-1] * level  # brings a stretch that starts at i to a common power

        def mix(h: np.ndarray) -> np.ndarray:
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            return h ^ (h >> np.uint64(29))

        grams = mix((sums[gram:] - sums[:-gram]) * lifted[: n - gram + 1])
        low = _slide(grams, width, np.minimum, _FREE)
        left = ends - length + 1  # windows of a piece start before this place
        piece = np.repeat(np.arange(len(pieces)), sizes)[: len(low)]
        valid = np.arange(len(low)) < left[piece]
        starts = valid.copy()
        starts[1:] &= ~valid[:-1] | (low[1:] != low[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(starts)
        if not len(first):
            return none
        stops = valid.copy()
        stops[:-1] &= ~valid[1:] | starts[1:]
        last = np.flatnonzero(stops)
        keys = low[first]
        content = mix((sums[last + length] - sums[first]) * lifted[first])
    # Grams that are smallest in a window: where one occurs twice in a piece, windows of one run may be equal.
    tops = np.where(valid, low, np.uint64(0))
    highest = np.concatenate([np.maximum.accumulate(tops[: width - 1]), _slide(tops, width, np.maximum, np.uint64(0))]) if len(tops) >= width else None
    if highest is None:
        anchors = np.flatnonzero(np.isin(grams, keys))
    else:
        tail = np.maximum.accumulate(tops[::-1][: width - 1])[::-1]
        highest = np.concatenate([highest, tail])[: len(grams)]
        anchors = np.flatnonzero(highest == grams)
    owner = np.repeat(np.arange(len(pieces)), sizes)[anchors]
    order = np.lexsort((grams[anchors], owner))
    g, o = grams[anchors][order], owner[order]
    again = np.unique(g[1:][(g[1:] == g[:-1]) & (o[1:] == o[:-1])])
    own = piece[first]
    begin = (ends - sizes)[own]
    return own, first - begin, last - first + 1, keys.astype(np.int64), content.astype(np.int64), np.isin(keys, again).astype(np.int64)


def _order(high: np.ndarray, low: np.ndarray, limit: int) -> np.ndarray:
    """Places sorted by (high, low), numbers below ``limit``; two passes by digits where these are short."""
    if limit <= 1 << 16:
        first = np.argsort(low.astype(np.uint16), kind="stable")
        return first[np.argsort(high.astype(np.uint16)[first], kind="stable")]
    return np.argsort(high.astype(np.int64) * limit + low, kind="stable")


def _suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols or more, by doubling sorted prefixes."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], text[order][1:] != text[order][:-1]]))
    step = 1
    while step < depth and rank[order[-1]] < n - 1:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        order = _order(rank, ahead, n + 1)
        a, b = rank[order], ahead[order]
        rank[order] = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        step *= 2
    return order


def repeated_windows(strings: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per string, which windows of ``length`` bytes also start elsewhere in the strings.

    On the Burrows-Wheeler transform of all strings, intervals of suffixes with a
    common prefix are extended backward by one symbol at a time, breadth first.
    An interval found at depth d ends where neighbouring suffixes have d symbols
    in common, if no shorter prefix ended there before; so common prefixes come
    out by increasing value, and the walk stops at ``length``: where no end was
    found, two neighbours share that many bytes or more.
    """
    count = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    text = np.empty(sizes.sum() + count, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[ends] = np.arange(count)
    text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + count
    n = len(text)
    suffix = _suffixes(text, length)
    before = text[suffix - 1]  # the transform; place 0 wraps to an end symbol
    step = np.empty(n, np.int64)
    step[np.argsort(before, kind="stable")] = np.arange(n)
    ended = np.zeros(n + 1, bool)
    ended[: count + 1] = True  # each end symbol is a suffix of its own kind
    ended[n] = True
    low, high = np.array([0]), np.array([n])
    for depth in range(length):
        if not len(low):
            break
        wide = high - low
        which = np.repeat(np.arange(len(low)), wide)
        rows = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat(low, wide)
        real = before[rows] >= count
        which, rows = which[real], rows[real]
        if not len(rows):
            break
        target, symbol = step[rows], before[rows]
        order = _order(which, target, n)
        which, target, symbol = which[order], target[order], symbol[order]
        new = np.concatenate([[True], (which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1])])
        low = target[new]
        high = target[np.concatenate([new[1:], [True]])] + 1
        fresh = ~ended[high]
        ended[high[fresh]] = True
        low, high = low[fresh], high[fresh]
        if not depth:  # the end symbols themselves are extended from here on
            low, high = np.append(low, np.arange(count)), np.append(high, np.arange(1, count + 1))
    shared = np.zeros(n, bool)
    tied = ~ended[1:n]
    shared[suffix[1:][tied]] = True
    shared[suffix[:-1][tied]] = True
    starts = ends - sizes
    return [np.flatnonzero(shared[a : a + max(s - length + 1, 0)]) for a, s in zip(starts, sizes, strict=True)]


def _stretches(at: np.ndarray) -> list[dict]:
    """Sorted numbers as stretches of neighbours."""
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)], strict=True)]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED) -> DataFrame:
    """(row, spans): per distinct row of (row, id, text), the windows that repeat anywhere, as stretches (a, b).

    Every window belongs to the key of its smallest gram hash; neighbouring
    windows with one key make a run. Runs, a fiftieth to a hundredth of the
    bytes, are counted by key, and keys seen once are dropped. Runs of equal
    content are one class: a key with one class has copies only, all of them
    repeated. Where classes differ, one string per class is fetched, and
    strings of the same keys meet in Burrows-Wheeler transforms of some ten
    thousand bytes, more only where one key has more. Keys with very many classes (such as a common line among
    different ones) take another exact way: their windows are grouped by a
    128-bit hash with map-side combine, so no task holds such a key.
    """

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pieces, owner, at = [], [], []
            held = 0

            def flush() -> pd.DataFrame:
                own, first, n, key, content, twice = window_runs(pieces, length, gram)
                return pd.DataFrame({"row": np.array(owner, np.int64)[own], "lo": np.array(at, np.int64)[own] + first, "n": n,
                                     "key": key, "content": content, "twice": twice})

            for row, text in zip(batch["row"], batch["text"], strict=True):
                data = _bytes(text)
                for a in range(0, max(len(data) - length + 1, 0), _CHUNK):
                    pieces.append(data[a : a + _CHUNK + length - 1])
                    owner.append(row)
                    at.append(a)
                    held += len(pieces[-1])
                    if held >= _CHUNK:
                        yield flush()
                        pieces, owner, at, held = [], [], [], 0
            if pieces:
                yield flush()

    slim = docs.select("row", "text")
    found = written(slim.mapInPandas(index, "row long, lo long, n long, key long, content long, twice long"))
    keys = found.groupBy("key").agg(F.count("*").alias("c"), F.max("twice").alias("t")).where("c > 1 OR t > 0").select("key")
    some = written(found.join(keys, "key", "left_semi"))
    classes = some.groupBy("key", "content").agg(
        F.count("*").alias("m"), F.min("n").alias("n"), F.max("twice").alias("twice"), F.min(F.struct("row", "lo")).alias("at")
    )
    kinds = classes.groupBy("key").agg(F.count("*").alias("kinds"), F.max("twice").alias("self"))
    classes = written(classes.join(kinds, "key"))
    copies = classes.where("kinds = 1 AND self = 0").select(
        "key", "content", F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("n") - 1).alias("b"))).alias("spans")
    )
    wanted = classes.where("kinds > 1 OR self > 0").groupBy(F.col("at.row").alias("row")).agg(
        F.collect_list(F.struct("key", "content", "m", "n", "kinds", F.col("at.lo").alias("lo"))).alias("wanted")
    )

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, want in zip(batch["text"], batch["wanted"], strict=True):
                data = _bytes(text)
                rows += [(w["key"], w["content"], w["m"], w["n"], w["kinds"], data[w["lo"] : w["lo"] + w["n"] + length - 1]) for w in want]
            yield pd.DataFrame(rows, columns=["key", "content", "m", "n", "kinds", "data"])

    strings = written(docs.join(wanted, "row").mapInPandas(
        fetch, "key long, content long, m long, n long, kinds long, data binary"
    ).dropDuplicates(["key", "content"]))

    def transform(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def flush() -> pd.DataFrame:
            part = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
            out = []
            for k, hits in enumerate(repeated_windows(part["data"].tolist(), length)):
                out.append(_stretches(np.arange(part["n"][k]) if part["m"][k] > 1 else hits))
            return part[["key", "content"]].assign(spans=out)

        for one in runs(batches, ["key"]):
            more = int(one["data"].map(len).sum()) + len(one)
            if held and size + more > _TRANSFORM:
                yield flush()
                held, size = [], 0
            held.append(one)
            size += more
        if held:
            yield flush()

    shape = "key long, content long, spans array<struct<a:long,b:long>>"
    compared = strings.where(F.col("kinds") <= crowded).repartition("key").sortWithinPartitions("key").mapInPandas(transform, shape)

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, content, m, n, data in zip(*(batch[c] for c in ("key", "content", "m", "n", "data")), strict=True):
                for a in range(n):
                    h = xxhash.xxh3_128_digest(data[a : a + length])
                    rows.append((key, content, a, m, h))
            yield pd.DataFrame(rows, columns=["key", "content", "a", "m", "hash"])

    listed = strings.where(F.col("kinds") > crowded).mapInPandas(windows, "key long, content long, a long, m long, hash binary")
    often = listed.groupBy("hash").agg(F.sum("m").alias("c")).where("c > 1").select("hash")
    grouped = listed.join(often, "hash").groupBy("key", "content").agg(
        F.sort_array(F.collect_list(F.struct("a", F.col("a").alias("b")))).alias("spans")
    )
    spans = copies.unionByName(compared).unionByName(grouped).where(F.size("spans") > 0)
    placed = some.join(spans, ["key", "content"]).select(
        "row", F.transform("spans", lambda s: F.struct((s["a"] + F.col("lo")).alias("a"), (s["b"] + F.col("lo")).alias("b"))).alias("spans")
    )
    return placed.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED,
                   id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept (binary) and kept_sha256.

    Removes each byte of a text's UTF-8 form that is covered by a string of
    ``length`` bytes which also starts anywhere else, in the same or another
    text; what repeats is judged on the input. Matches never cross texts. A
    NULL text is empty; texts shorter than ``length`` stay whole; equal rows
    repeat each other; a cut may leave bytes that are no valid UTF-8, hence
    binary. No rows give no rows; other columns are ignored.
    """
    rows = docs.select(F.xxhash64(F.col(id), F.col(text)).alias("row"), F.col(id).cast("string").alias("id"), F.col(text).alias("text"))
    found = find_repeats(rows, length, gram, crowded)

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, text_, spans in zip(batch["id"], batch["text"], batch["spans"], strict=True):
                data = _bytes(text_)
                kept, at, removed, count = [], 0, 0, 0
                if spans is not None:
                    reach = -1
                    for a, b in sorted((s["a"], s["b"] + length) for s in spans):
                        if a > reach:
                            kept.append(data[at:a])
                            count += 1
                            removed += b - a
                        elif b > reach:
                            removed += b - reach
                        reach = max(reach, b)
                        at = reach
                kept.append(data[at:])
                whole = b"".join(kept)
                out.append((id_, len(data), removed, count, whole, hashlib.sha256(whole).hexdigest()))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    done = rows.join(found, "row", "left").select("id", "text", "spans").mapInPandas(
        cut_out, "id string, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    )
    return done.withColumn("id", F.col("id").cast(dict(docs.dtypes)[id])).withColumnRenamed("id", id)
