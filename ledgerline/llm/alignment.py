"""Alignment of two tokenizers by pointer jumping over overlapping tokens."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import written

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Tokens of A whose links are counted together, and bytes of text aligned in one pass of arrays.
BLOCK = 1 << 22
_PIECE = 1 << 20
# Runs of white space beyond this go through the slower, linear encoder.
_LONG_SPACE = re.compile(r"\s{20000}")


def _byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(c): b for c, b in [*zip(plain, plain, strict=True), *((256 + k, b) for k, b in enumerate(rest))]}


class ByteLevel:
    """A byte-level BPE read from its JSON file; special tokens are plain text."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        special = {t["id"] for t in given["added_tokens"] if t["special"]}
        values = _byte_values()
        self.bytes = {i: bytes(values[c] for c in entry) for entry, i in given["model"]["vocab"].items() if i not in special}
        self.size = 1 + max(max(self.bytes), *special)
        # The same ranks in an encoder that is several times as fast; words are split as in byte-level BPE.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if _LONG_SPACE.search(text):
            return self.plain.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Pieces:
    """A sentence-piece model with byte fallback, which puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes = {}
        for i in range(self.size):
            piece = self.model.id_to_piece(i)
            self.bytes[i] = bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@lru_cache(maxsize=4)
def _loaded(folder: str, a_file: str, b_file: str) -> Aligner:
    return Aligner(ByteLevel(os.path.join(folder, a_file)), Pieces(os.path.join(folder, b_file)))


def jump(successor: np.ndarray) -> np.ndarray:
    """The last node on each node's path: pointers double until none moves."""
    while True:
        ahead = successor[successor]
        if np.array_equal(ahead, successor):
            return successor
        successor = ahead


def farthest(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """Per token (those of A, then those of B) the farthest-right token that overlaps it; a terminal is its own.

    The token of the other side that reaches a token's last byte overlaps it
    and ends last. Where both end together, the one of B is the terminal.
    """
    n = len(end_a)
    to_b = np.searchsorted(end_b, end_a, "left")
    to_a = np.searchsorted(end_a, end_b, "left")
    own = np.arange(n, n + len(end_b))
    return np.concatenate([to_b + n, np.where(end_a[to_a] > end_b, to_a, own)])


class Aligner:
    """Vectorised alignment of a piece of a partition: many texts in one pass."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.length = [np.zeros(x.size, np.int64) for x in (a, b)]
        for side, x in enumerate((a, b)):
            for i, value in x.bytes.items():
                self.length[side][i] = len(value)
        # Ids as text with the mark that follows: "," inside a side, "|" after A's, ";" after B's.
        wide = f"S{len(str(max(a.size, b.size))) + 1}"
        self.text = [np.array([[b"%d%s" % (i, mark) for i in range(x.size)] for mark in marks], wide)
                     for x, marks in ((a, (b",", b"|")), (b, (b",", b";")))]
        # Pairs are numbers below the product of both sizes, stored in as many bytes as that takes.
        self.pair_type = np.uint32 if a.size * b.size < 1 << 32 else np.uint64

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, None where a text has no tokens."""
        if not text:
            return None
        whole = (" " + text).encode("utf-8", "surrogatepass")
        ids = self.a.encode(" " + text), self.b.encode(text)
        for x, found in zip((self.a, self.b), ids, strict=True):
            if b"".join(map(x.bytes.get, found)) != whole:
                return None
        return tuple(np.array(x, np.int64) for x in ids)

    def align(self, given: list[tuple[np.ndarray, np.ndarray]]) -> dict:
        """Figures per text and all distinct (text, pair) with their numbers of links."""
        count = len(given)
        ids = [np.concatenate([g[s] for g in given]) for s in (0, 1)]
        sizes = [np.array([len(g[s]) for g in given]) for s in (0, 1)]
        end = [np.cumsum(self.length[s][ids[s]]) for s in (0, 1)]
        n = len(ids[0])
        terminal = jump(farthest(*end))
        # A terminal lies last in its group, so numbering terminals by place numbers the groups in order.
        last = np.unique(terminal)
        group = np.searchsorted(last, terminal)
        group = group[:n], group[n:]
        members = [np.bincount(g, minlength=len(last)) for g in group]
        before = [np.concatenate([[0], np.cumsum(m)]) for m in members]
        doc = [np.repeat(np.arange(count), s) for s in sizes]
        place = [np.arange(n) + before[1][group[0]], np.arange(len(ids[1])) + before[0][group[1] + 1]]
        written = np.empty(n + len(ids[1]), self.text[0].dtype)
        for s in (0, 1):
            closes = np.append(group[s][1:] != group[s][:-1], True).astype(np.int64)
            written[place[s]] = self.text[s][closes, ids[s]]
        stops = np.cumsum(sizes[0] + sizes[1])
        digests = [hashlib.sha256(written[e - k : e].tobytes().translate(None, b"\0")[:-1]).hexdigest()
                   for e, k in zip(stops.tolist(), (sizes[0] + sizes[1]).tolist(), strict=True)]
        start = end[0] - self.length[0][ids[0]]
        first, final = np.searchsorted(end[1], start, "right"), np.searchsorted(end[1], end[0], "left")
        links = final - first + 1
        left = np.repeat(np.arange(n), links)
        right = np.arange(len(left)) - np.repeat(np.cumsum(links) - links, links) + np.repeat(first, links)
        width = self.a.size * self.b.size
        keys, times = np.unique(doc[0][left] * width + ids[0][left] * self.b.size + ids[1][right], return_counts=True)
        owner = keys // width
        return {
            "n_a": sizes[0], "n_b": sizes[1], "n_groups": np.bincount(doc[1][last - n], minlength=count),
            "n_links": np.bincount(doc[0], links, count).astype(np.int64), "digests": digests,
            "pairs": keys % width, "times": times, "bounds": np.searchsorted(owner, np.arange(count + 1)),
        }

    def pack(self, pairs: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
        """A text's rising pairs as steps, and their numbers of links; equal bytes of all numbers lie together and compress."""
        steps = np.diff(pairs, prepend=0).astype(self.pair_type)
        return _planes(steps), _planes(times.astype(np.uint32))

    def unpack(self, pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(_joined(pairs, self.pair_type), dtype=np.int64), _joined(times, np.uint32).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _joined(planes: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


_ENCODED = ("block long, held boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "pairs binary, times binary, seen array<long>, docs array<long>")


def _encoded(schema: pa.Schema, folder: str, a_file: str, b_file: str, block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text, and per block of texts a row with its pairs and in how many of its texts each occurs."""
    aligner = _loaded(folder, a_file, b_file)
    task, at, filled = TaskContext.get().partitionId(), 0, 0
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    names = [f.name for f in schema]

    def summed() -> tuple[np.ndarray, np.ndarray]:
        pairs = np.concatenate([s[0] for s in seen])
        docs = np.concatenate([s[1] for s in seen])
        unique, where = np.unique(pairs, return_inverse=True)
        return unique, np.bincount(where, docs, len(unique)).astype(np.int64)

    def rows(ids: pa.Array, columns: dict) -> pa.RecordBatch:
        arrays = [ids, *[pa.array(columns[c], t) if c in columns else pa.nulls(len(ids), t) for c, t in zip(names[1:], schema.types[1:], strict=True)]]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def close() -> pa.RecordBatch:
        pairs, docs = summed()
        seen.clear()
        return rows(pa.nulls(1, schema.types[0]), {"block": [(task << 24) + at], "held": [True], "seen": [pairs], "docs": [docs]})

    def piece(ids: pa.Array, found: list) -> pa.RecordBatch:
        have = [k for k, f in enumerate(found) if f is not None]
        figures = {c: np.zeros(len(found), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        digests, pairs, times = [""] * len(found), [b""] * len(found), [b""] * len(found)
        if have:
            made = aligner.align([found[k] for k in have])
            for c, values in figures.items():
                values[have] = made[c]
            bounds = made["bounds"].tolist()
            for k, digest, a, b in zip(have, made["digests"], bounds, bounds[1:], strict=False):
                digests[k] = digest
                pairs[k], times[k] = aligner.pack(made["pairs"][a:b], made["times"][a:b])
            seen.append(np.unique(made["pairs"], return_counts=True))
            if len(seen) > 16:
                seen[:] = [summed()]
        block_id = [(task << 24) + at] * len(found)
        return rows(ids, {"block": block_id, "held": [False] * len(found), **figures, "groups_sha256": digests, "pairs": pairs, "times": times})

    for batch in batches:
        ids, texts = batch.columns
        since, size, found = 0, 0, []
        for k, text in enumerate(texts.to_pylist()):
            found.append(aligner.tokens(text))
            if found[-1] is not None:
                filled += len(found[-1][0])
                size += len(text)
            if size >= _PIECE or filled >= block or k + 1 == len(texts):
                yield piece(ids.slice(since, k + 1 - since), found)
                since, size, found = k + 1, 0, []
            if filled >= block:
                yield close()
                at, filled = at + 1, 0
    if seen:
        yield close()


def align(docs: DataFrame, folder: str = TOKENIZERS, a_file: str = A_FILE, b_file: str = B_FILE, block: int = BLOCK,
          id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs`` how the tokens of two tokenizers meet: groups, links and how usual the linked ids are.

    Each token points to the farthest-right token that overlaps it; doubling
    the pointers takes every token to the terminal of its group. Links are the
    overlapping pairs of tokens; an id pair counts the documents that hold it
    linked. ``n_best`` are the links whose pair counts most for its A id.

    Texts are encoded once, into a written table. Blocks of about 4 million
    tokens list their own pairs, so that a pair meets its other blocks in one
    window with a row a block, however usual it is, and the counts come back a
    block at a time. The best count per A id is one row per vocabulary entry,
    hence small enough to broadcast. No pair list reaches the driver.

    NULL and empty texts, and texts whose tokens don't spell them, have zeros
    and an empty digest. Rows repeat as given, with any ids, also NULL; each row
    is a document. A single text is aligned in one task, whatever its length.
    No rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    id_type = given.schema["id"].dataType
    schema = f"id {id_type.simpleString()}, {_ENCODED}"
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [pa.field(*(lambda c: (c[0], arrow[c[1]]))(f.split(" "))) for f in _ENCODED.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        own = pa.schema([pa.field("id", first.schema.field(0).type), *fields])
        yield from _encoded(own, folder, a_file, b_file, block, (b for part in ([first], batches) for b in part))

    encoded = written(given.mapInArrow(encode, schema))
    other = _b_size(folder, b_file)
    seen = encoded.where("held").select("block", F.explode(F.arrays_zip("seen", "docs")).alias("s")).select("block", "s.*")
    total = F.sum("docs").over(Window.partitionBy("pair"))
    counted = written(seen.withColumnRenamed("seen", "pair").select("block", "pair", total.alias("n")))
    first_id = F.expr(f"pair div {other}")
    best = counted.groupBy(first_id.alias("a")).agg(F.max("n").alias("most"))
    lookup = counted.withColumn("a", first_id).join(F.broadcast(best), "a").select("block", "pair", "n", (F.col("n") == F.col("most")).alias("best"))

    figures = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        pairs, n, top = (right.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
        unpack = _loaded(folder, a_file, b_file).unpack
        out = {"n_best": np.zeros(len(left), np.int64), "count_sum": np.zeros(len(left), np.int64)}
        for k, (steps, times) in enumerate(zip(left.column("pairs"), left.column("times"), strict=True)):
            steps, times = steps.as_py(), times.as_py()
            if steps:
                steps, times = unpack(steps, times)
                at = np.searchsorted(pairs, steps)
                out["n_best"][k], out["count_sum"][k] = times[top[at]].sum(), (times * n[at]).sum()
        for c, values in out.items():
            left = left.append_column(c, pa.array(values))
        return left.select(["id", *figures, "groups_sha256"])

    rows = encoded.where("not held").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    out_schema = f"id {id_type.simpleString()}, {', '.join(f'{c} long' for c in figures)}, groups_sha256 string"
    out = rows.groupBy("block").cogroup(lookup.groupBy("block")).applyInArrow(sums, out_schema)
    return out.withColumnRenamed("id", id)


def _b_size(folder: str, b_file: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, b_file)).get_piece_size()
