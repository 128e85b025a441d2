"""Connected components of a graph of any size by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut


def _downward(edges: DataFrame, a: str, b: str) -> DataFrame:
    return (
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the smallest.

    Each round points the larger neighbours of a node at its smallest neighbour
    (large star) and then the node and its smaller neighbours too (small star),
    so paths halve and a few rounds do for any shape. A round is two groupings
    with map-side combine and two equi-joins, whose hot nodes adaptive execution
    splits. Only a row count and one hash per round reach the driver. NULL ends
    drop an edge; no edges give no rows.
    """
    edges = cut(_downward(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b))
    state = _state(edges)
    while state[0]:
        # The smallest neighbour of a node that is smaller than itself; a node without one is a root.
        low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
        large = edges.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array("u", "v")).alias("u")
        small = large.join(least, "u").select(ends, F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        edges = cut(small)
        before, state = state, _state(edges)
        if state == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select("root", "root").distinct())
