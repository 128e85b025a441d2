"""Approximate nearest neighbours on several shifted Hilbert curves."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, runs, written
from ledgerline.operators.ranking import rank_within

# Orderings, projected components of each and bits a component.
CURVES, AXES, BITS = 8, 8, 6
# Queries whose true neighbours fit the window, and the share of them it must reach.
SAMPLE, REACHED = 128, 0.97
# Rows of a block of a curve at least and at most; between them a block is as long as the window.
BLOCKS = (64, 1 << 18)
# Scores held at once.
_CELLS = 1 << 22


@cache
def _axes(curve: int, size: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """A curve's random directions and shifts."""
    rng = np.random.default_rng((curve, size))
    q, _ = np.linalg.qr(rng.standard_normal((size, size)))
    return q[:, : min(axes, size)], rng.uniform(-0.5, 0.5, min(axes, size))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows of whole numbers below 2^bits) on the Hilbert curve through all cells.

    The usual bitwise form: undo the turns of each level from the highest bit
    down, Gray-decode across the axes, then interleave.
    """
    axes = [cells[:, k].astype(np.uint64) for k in range(cells.shape[1])]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for k, axis in enumerate(axes):
            is_set = axis & bit != 0
            swap = np.where(is_set, np.uint64(0), (axes[0] ^ axis) & below)
            axes[0] = axes[0] ^ np.where(is_set, below, swap)
            if k:
                axes[k] = axis ^ swap
    for k in range(1, len(axes)):
        axes[k] = axes[k] ^ axes[k - 1]
    turn = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] & np.uint64(1 << level) != 0, np.uint64((1 << level) - 1), np.uint64(0))
    key = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << one) | (((axis ^ turn) >> np.uint64(level)) & one)
    return key


def curve_keys(vectors: np.ndarray, longest: float, as_query: bool, curves: int, axes: int, bits: int) -> np.ndarray:
    """One key per vector and curve.

    Candidates get one more component that brings them all to the length of the
    longest, queries a zero there, so the largest inner product lies at the
    smallest angle.
    """
    units = vectors / longest
    if as_query:
        units = units / np.linalg.norm(units, axis=1, keepdims=True)
        extra = np.zeros(len(units))
    else:
        extra = np.sqrt(np.maximum(1 - (units * units).sum(axis=1), 0))
    units = np.concatenate([units, extra[:, None]], axis=1)
    size = units.shape[1]
    out = np.empty((len(units), curves), np.int64)
    for c in range(curves):
        turn, shift = _axes(c, size, axes)
        # Components of a random direction spread like 1 / sqrt(size); four deviations cover them, the rest joins the edge.
        at = (units @ turn * np.sqrt(size) + 4.5 + shift) / 9
        out[:, c] = hilbert((np.clip(at, 0, 1 - 1e-9) * (1 << bits)).astype(np.int64), bits).view(np.int64)
    return out


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors in two bytes a component, their scales, and the length of what the codes lose."""
    scale = np.abs(vectors).max(axis=1) / 32767
    small = np.rint(vectors / scale[:, None]).astype(np.int16)
    lost = vectors - small * scale[:, None]
    return small, scale, np.sqrt((lost * lost).sum(axis=1)) * (1 + 1e-9)


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def search(vectors: DataFrame, queries: Column, k: int = 20, curves: int = CURVES, axes: int = AXES, bits: int = BITS,
           reached: float = REACHED, sample: int = SAMPLE, block: int | None = None, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` picks, the ``k`` rows of largest inner product found.

    All rows are in the index: each has a place on every curve, and a query
    meets the rows within a window of places around its own. The window is
    fitted so that ``reached`` of the true neighbours of ``sample`` queries
    (searched exhaustively, a bounded number) lie in one of their windows; it
    widens where vectors have no structure and narrows where they have. Curves
    are range-partitioned; their blocks are tasks that hold two bytes a
    component. A block is as long as the window (within bounds), so a query
    meets about three on a curve and brings home few more than ``k`` + 1 rows
    from each. Error bounds of the codes decide which pairs can be among the
    nearest, and those are computed in double precision on the vectors as
    given, so coding loses nothing.

    Equal vectors are one point with its ``k`` + 1 smallest ids: a third of all
    rows being one vector makes neither a hot block nor more pairs. Ties go to
    the smaller id. Vectors that are NULL, empty, zero or hold NULL or
    non-finite components take no part, as query or candidate; vectors of
    different lengths don't meet. Of rows that repeat an id, only one is a
    query's own. NULL ids are candidates, last of a tie, and queries where
    ``queries`` says so. No rows give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    value = F.col(embedding)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite & F.exists(value, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id).alias("id"), value.alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")).where(good)
    by_id = Window.partitionBy("vector").orderBy(F.col("id").asc_nulls_last())
    first_ids = rows.select("id", "vector").withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
    points = first_ids.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("nth", "id"))).alias("ids"))
    points = points.withColumn("point", F.monotonically_increasing_id())
    points = written(points.select("point", F.size("vector").alias("size"), "vector", F.col("ids.id").alias("ids")))
    asked = rows.where("asks").select("id", "vector").withColumn("query", F.monotonically_increasing_id())
    asked = written(asked.join(points.select("point", "vector"), "vector").select("query", "id", "point"))
    longest = points.agg(F.max(F.sqrt(dot(F.col("vector"), F.col("vector"))))).first()[0]
    if longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asking = points.join(asked.select("point").distinct(), "point", "left_semi")

    def placed(as_query: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for size, part in batch.groupby("size"):
                    keys = curve_keys(_stacked(part["vector"]), longest, as_query, curves, axes, bits)
                    yield pd.DataFrame({"point": part["point"], "size": size, "asks": as_query, "keys": keys.tolist()})
        return run

    schema = "point long, size int, asks boolean, keys array<long>"
    slim = ("point", "size", "vector")
    keyed = points.select(*slim).mapInPandas(placed(False), schema).union(asking.select(*slim).mapInPandas(placed(True), schema))
    spread = keyed.select("point", "size", "asks", F.posexplode("keys").alias("curve", "key"))
    ranked = rank_within(spread, ["size", "curve"], [F.col("key"), F.col("point"), F.col("asks")])
    ranked = written(ranked.select("point", "size", "asks", "curve", F.col("rank").alias("place"), "group_size"))
    window = _window(points, asking, ranked, k, reached, sample)
    block = block or min(max(window, BLOCKS[0]), BLOCKS[1])

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby("size"):
                small, scale, lost = codes(_stacked(part["vector"]))
                yield pd.DataFrame({"point": part["point"], "code": [x.tobytes() for x in small], "scale": scale, "lost": lost})

    compact = points.select(*slim).mapInPandas(coded, "point long, code binary, scale double, lost double")
    at = F.col("place") - 1
    held = ranked.where("not asks").select("point", "size", "curve", F.expr(f"(place - 1) div {block}").alias("block"))
    held = held.join(compact, "point").withColumn("vector", F.lit(None).cast(points.schema["vector"].dataType))
    near = F.sequence(F.call_function("div", F.greatest(at - window, F.lit(0)), F.lit(block)),
                      F.call_function("div", F.least(at + window, F.col("group_size") - 1), F.lit(block)))
    sought = ranked.where("asks").select("point", "size", "curve", F.explode(near).alias("block"))
    sought = sought.join(asking.select("point", "vector"), "point")
    work = held.unionByName(sought, allowMissingColumns=True).withColumn("task", F.xxhash64("size", "curve", "block"))
    work = work.select("task", "size", "curve", "block", "point", "code", "scale", "lost", "vector")
    keys = ["size", "curve", "block"]
    work = work.repartition("task").sortWithinPartitions("task", *keys)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for one in runs(batches, keys):
            asks = one["code"].isna().to_numpy()
            if asks.all() or not asks.any():
                continue
            there = one[~asks]
            size = int(one["size"].iloc[0])
            small = np.frombuffer(b"".join(there["code"]), np.int16).reshape(-1, size).T.astype(np.float64)
            names, scale, lost = (there[c].to_numpy() for c in ("point", "scale", "lost"))
            wanted, who = _stacked(one.loc[asks, "vector"]), one.loc[asks, "point"].to_numpy()
            strip = max(1, _CELLS // len(names))
            for a in range(0, len(who), strip):
                q = wanted[a : a + strip]
                about = (q @ small) * scale
                error = np.linalg.norm(q, axis=1)[:, None] * lost * (1 + 1e-9)
                least = about - error
                keep = min(k + 1, len(names))
                floor = np.partition(least, len(names) - keep, axis=1)[:, len(names) - keep]
                i, j = np.nonzero(about + error >= floor[:, None])
                yield pd.DataFrame({"asker": who[a : a + strip][i], "point": names[j], "least": least[i, j], "most": (about + error)[i, j]})

    met = work.mapInPandas(compare, "asker long, point long, least double, most double")
    # A pair met on several curves has the same bounds each time.
    met = met.groupBy("asker", "point").agg(F.max("least").alias("least"), F.max("most").alias("most"))
    down = Window.partitionBy("asker").orderBy(F.col("least").desc(), "point")
    floor = F.max(F.when(F.col("nth") == k + 1, F.col("least"))).over(Window.partitionBy("asker"))
    near_pairs = met.withColumn("nth", F.row_number().over(down)).withColumn("floor", floor)
    near_pairs = near_pairs.where(F.col("floor").isNull() | (F.col("most") >= F.col("floor"))).select("asker", "point")
    sides = near_pairs.join(points.select("point", "vector", "ids"), "point")
    sides = sides.join(asking.select(F.col("point").alias("asker"), F.col("vector").alias("wanted")), "asker")
    scored = sides.select("asker", "point", dot(F.col("wanted"), F.col("vector")).alias("score"), "ids")
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
    each = scored.select("asker", "point", "score", F.explode("ids").alias("vec_id"))
    each = each.withColumn("nth", F.row_number().over(Window.partitionBy("asker").orderBy(*order, "point"))).where(F.col("nth") <= k + 1)
    mine = F.col("vec_id").eqNullSafe(F.col("id")) & (F.col("asker") == F.col("point"))
    found = asked.withColumnRenamed("point", "asker").join(each, "asker").withColumn("mine", mine)
    own = F.row_number().over(Window.partitionBy("query", "mine").orderBy("nth"))
    found = found.withColumn("own", own).where("not (mine and own = 1)")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("nth"))).where(F.col("rank") <= k)
    return found.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")


def _window(points: DataFrame, asking: DataFrame, ranked: DataFrame, k: int, reached: float, sample: int) -> int:
    """Places to either side in which ``reached`` of the true neighbours of up to ``sample`` queries lie on some curve."""
    drawn = asking.select("point", "size", "vector").orderBy(F.xxhash64("point"), "point").limit(sample).toPandas()
    wanted = {size: (part["point"].to_numpy(), _stacked(part["vector"])) for size, part in drawn.groupby("size")}

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                if size not in wanted:
                    continue
                who, q = wanted[size]
                scores, names = q @ _stacked(part["vector"]).T, part["point"].to_numpy()
                scores[who[:, None] == names] = -np.inf
                keep = min(k, len(names))
                top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                yield pd.DataFrame({"asker": np.repeat(who, keep), "point": names[top.ravel()],
                                    "score": np.take_along_axis(scores, top, axis=1).ravel()})

    true = points.select("point", "size", "vector").mapInPandas(best, "asker long, point long, score double")
    down = Window.partitionBy("asker").orderBy(F.col("score").desc(), "point")
    true = true.withColumn("nth", F.row_number().over(down)).where((F.col("nth") <= k) & (F.col("score") > float("-inf")))
    true = cut(true.select("asker", "point"))
    theirs = ranked.where("not asks").select("point", "curve", "place").join(true, "point")
    own = ranked.where("asks").select(F.col("point").alias("asker"), "curve", F.col("place").alias("own"))
    apart = theirs.join(own, ["asker", "curve"]).groupBy("asker", "point").agg(F.min(F.abs(F.col("place") - F.col("own"))).alias("apart"))
    far = apart.agg(F.percentile("apart", F.lit(reached))).first()[0]
    return int(np.ceil(far)) + 1 if far is not None else 1
