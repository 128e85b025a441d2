"""Near-duplicate embeddings by rotated binary codes with correction factors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, runs
from ledgerline.llm.components import components

COSINE = 0.9
RECALL = 0.98
# Vectors a bucket should hold; the number of bits of a bucket key follows from it.
BUCKET = 512
# Rows of a block; larger buckets are compared block by block in different tasks.
BLOCK = 2048
# Deviations of the estimate that its confidence bound allows for.
BOUND = 3.5
_STRIP = 256


@cache
def _rotation(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng((seed, size)).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _units(vectors: np.ndarray) -> np.ndarray:
    # The largest component first: squares of very large or small ones leave the range of doubles.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits, tables): keys long enough for small buckets, tables enough for the recall at the threshold itself."""
    bits = min(60, max(2, ceil(log2(max(n, 1) / bucket)))) if n > bucket else 2
    agree = (1 - acos(cosine) / pi) ** bits
    return bits, ceil(log(1 - recall) / log(1 - agree))


def bucket_keys(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One key per vector and table: the signs of rotated components."""
    units, size = _units(vectors), vectors.shape[1]
    turned = [units @ _rotation(size, 1 + k).T > 0 for k in range(ceil(bits * tables / size))]
    signs = np.concatenate(turned, axis=1)[:, : bits * tables].reshape(len(vectors), tables, bits)
    return (signs.astype(np.int64) << np.arange(bits, dtype=np.int64)).sum(axis=2)


class Codes:
    """Sign codes of rotated unit vectors with the factor that makes their estimates unbiased."""

    def __init__(self, vectors: np.ndarray):
        self.units = _units(vectors)
        self.turned = self.units @ _rotation(vectors.shape[1], 0).T
        size = vectors.shape[1]
        self.code = np.where(self.turned > 0, 1.0, -1.0) / sqrt(size)
        # How much of a vector its code keeps; <code, q> / factor estimates <vector, q> without bias.
        self.factor = (self.code * self.turned).sum(axis=1)
        lost = np.maximum(1 - self.factor**2, 0) / self.factor**2
        self.error = BOUND * np.sqrt(lost / max(size - 1, 1))

    def upper(self, a: slice, other: Codes) -> np.ndarray:
        """Upper confidence bounds of the cosines of rows ``a`` to all of ``other``, the lower of both ways round."""
        mine = (self.code[a] @ other.turned.T) / self.factor[a, None] + self.error[a, None]
        theirs = (self.turned[a] @ other.code.T) / other.factor[None, :] + other.error[None, :]
        return np.minimum(mine, theirs)


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the sets of a and b, edge by edge, in arrays."""
    while True:
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        if (low == high).all():
            return
        np.minimum.at(parent, high, low)


def block_links(left: np.ndarray, right: np.ndarray, weights: tuple, keys: tuple, table: int, same: bool, cosine: float):
    """Links between two blocks of one bucket: partners gained per row, and each row's set.

    Bounds decide which pairs are computed again in double precision. A pair that
    an earlier table brings together too is counted there.
    """
    a, b = Codes(left), None
    b = a if same else Codes(right)
    n, offset = len(left), 0 if same else len(left)
    total = n + (0 if same else len(right))
    gained, parent = np.zeros(total, np.int64), np.arange(total)
    for at in range(0, n, _STRIP):
        strip = slice(at, min(at + _STRIP, n))
        i, j = np.nonzero(a.upper(strip, b) >= cosine)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        sure = np.einsum("ij,ij->i", a.units[i], b.units[j]) >= cosine
        i, j = i[sure], j[sure]
        if table:
            fresh = ~(keys[0][i, :table] == keys[1][j, :table]).any(axis=1)
            i, j = i[fresh], j[fresh]
        np.add.at(gained, i, weights[1][j])
        np.add.at(gained, j + offset, weights[0][i])
        _join(parent, i, j + offset)
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return gained, parent


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET,
                    id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Equal vectors are one class first. Classes get bucket keys from the signs of
    randomly rotated components in as many tables as the recall asks for; all
    rows are in the index. Inside a bucket, sign codes of another rotation with
    their stored factors give unbiased estimates of all cosines; pairs whose
    upper confidence bound reaches ``cosine`` are computed exactly, in double
    precision, so that no link is below the threshold. A bucket beyond 2,048
    rows is split into blocks, and each pair of blocks is a task of its own.
    A block reports sums and sets per row, not pairs.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components
    link with nothing and stand alone, as does any vector with none in reach;
    vectors of different lengths don't link. Repeated rows are separate rows
    that link with each other. A NULL id is never a component's smallest; kept
    is then false. No rows give no rows; other columns are ignored.
    """
    value = F.col(embedding)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite & F.exists(value, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id).alias("id"), F.when(good, value.cast("array<double>")).alias("vector"))
    rows = rows.withColumn("class", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    classes = cut(rows.where("class IS NOT NULL").groupBy("class").agg(
        F.first("vector").alias("vector"), F.count("*").alias("n"), F.min("id").alias("first")
    ))
    bits, tables = plan(classes.count(), cosine, recall, bucket)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["vector"].map(len)):
                keys = bucket_keys(np.stack(part["vector"].to_numpy()), bits, tables)
                yield part.assign(keys=keys.tolist())

    keyed = cut(classes.select("class", "vector", "n").mapInPandas(
        index, "class long, vector array<double>, n long, keys array<long>"
    ))
    spread = keyed.select("class", F.size("vector").alias("size"), F.posexplode("keys").alias("table", "key"))
    sizes = spread.groupBy("size", "table", "key").agg(F.count("*").alias("held")).where("held > 1")
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    members = spread.join(sizes.withColumn("blocks", blocks).drop("held"), ["size", "table", "key"])
    members = members.withColumn("own", F.pmod(F.hash("class"), F.col("blocks")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("class", "table", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
                             F.xxhash64("size", "table", "key", F.least("own", "other"), F.greatest("own", "other")).alias("task"))
    work = members.join(keyed, "class").repartition("task").sortWithinPartitions("task", "class")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for one in runs(batches, ["task"]):
            own, i, j = one["own"].to_numpy(), one["i"].iloc[0], one["j"].iloc[0]
            sides = [one[own == i], one[own == j]] if i != j else [one, one]
            if not len(sides[0]) or not len(sides[1]):
                continue
            data = [np.stack(s["vector"].to_numpy()) for s in sides]
            keys = tuple(np.stack(s["keys"].to_numpy()) for s in sides)
            weights = tuple(s["n"].to_numpy() for s in sides)
            gained, parent = block_links(data[0], data[1], weights, keys, int(one["table"].iloc[0]), i == j, cosine)
            names = sides[0]["class"].to_numpy()
            names = names if i == j else np.concatenate([names, sides[1]["class"].to_numpy()])
            some = gained > 0
            yield pd.DataFrame({"class": names[some], "links": gained[some], "root": names[parent[some]]})

    found = cut(work.select("task", "class", "table", "i", "j", "own", "vector", "n", "keys").mapInPandas(
        compare, "class long, links long, root long"
    ))
    roots = components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "class"})
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    named = classes.select("class", "n", "first").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = named.groupBy("root").agg(F.min("first").alias("smallest"))
    named = named.join(smallest, "root").join(links, "class", "left").select(
        "class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "smallest"
    )
    out = rows.select("id", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("smallest"))
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
