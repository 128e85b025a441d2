"""Exact ranks and neighbours inside groups of any size.

A window over one group runs in one task, which a group holding a third of all
rows would choke. Here the rows are range-partitioned by group and order, so a
large group spans many tasks; row positions inside each partition plus running
partition totals give the exact rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import ensure_checkpoint_dir

_POSITION_BITS = 33


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add ``name`` (1 is first) and ``group_size`` per ``keys``.

    ``order`` must be total within a group and ``keys`` not NULL. The sorted
    rows are checkpointed: the partition a row landed in must be the same in
    both uses below, also after an executor is lost.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *order]
    placed = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    placed = placed.withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    placed = placed.withColumn("__part", F.shiftright("__id", _POSITION_BITS)).withColumn(
        "__pos", F.col("__id").bitwiseAND((1 << _POSITION_BITS) - 1)
    )
    # One row per group and partition, however large the group is.
    spans = placed.groupBy(*keys, "__part").agg(F.min("__pos").alias("__first"), F.count("*").alias("__n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("__before", F.coalesce(before, F.lit(0))).withColumn(
        "group_size", F.sum("__n").over(w)
    ).drop("__n")
    out = placed.join(spans, [*keys, "__part"])
    rank = F.col("__before") + F.col("__pos") - F.col("__first") + 1
    return out.withColumn(name, rank.cast("long")).select(*df.columns, name, "group_size")


def neighbours(
    ranked: DataFrame, keys: Sequence[str], before: int, after: int, columns: dict[str, str], rank: str = "rank"
) -> DataFrame:
    """Pair each row with the rows up to ``before`` and ``after`` places away.

    An equi-join on (group, rank); no row meets more than ``before + after``
    others. ``columns`` maps the neighbour's columns to their new names.
    """
    offsets = [k for k in range(-before, after + 1) if k != 0]
    probe = ranked.withColumn("offset", F.explode(F.array(*[F.lit(k) for k in offsets])))
    probe = probe.withColumn("__at", F.col(rank) + F.col("offset"))
    other = ranked.select(
        *keys, F.col(rank).alias("__at"), *[F.col(a).alias(b) for a, b in columns.items()]
    )
    return probe.join(other, [*keys, "__at"]).drop("__at")


def metric_ranks(values: DataFrame, keys: Sequence[str] = ("metric",), label: str = "ticker") -> DataFrame:
    """Rank and percentile of each company per metric; missing values last."""
    order = [F.col("value").desc_nulls_last(), F.col(label)]
    ranked = rank_within(values, keys, order)
    share = (F.col("rank") - 1) * F.lit(100.0) / F.col("group_size")
    return ranked.withColumn("percentile", F.lit(100.0) - share).withColumn("best", F.col("rank") == 1)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of the sorted rows, with the number of pages."""
    ranked = rank_within(df, [], order)
    lo = (number - 1) * size
    pages = F.ceil(F.col("group_size") / size).cast("long")
    inside = F.col("rank").between(lo + 1, lo + size)
    return ranked.where(inside).withColumn("total_pages", pages).drop("group_size")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rn") -> DataFrame:
    """The first n rows per group; losers are dropped before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
