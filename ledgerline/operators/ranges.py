"""Joins on a key plus a bounded distance, without pairing whole groups.

Both sides are cut into buckets as wide as the window. The probe side looks
into the few buckets its window touches, so each row meets only neighbours and
a hot key is split by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    lo: Column,
    hi: Column,
    point: Column,
    width: int,
    left_key: list[str] | None = None,
) -> DataFrame:
    """Pair rows with equal ``keys`` and ``lo <= point <= hi``.

    ``lo`` and ``hi`` are whole numbers over ``left`` and ``point`` over
    ``right``. With ``left_key``, a unique key of ``left``, unmatched rows of
    ``left`` are kept. Columns other than ``keys`` must differ by name.
    """
    probe = left.withColumn("__lo", lo.cast("long")).withColumn("__hi", hi.cast("long"))
    first = F.floor(F.col("__lo") / width).cast("long")
    last = F.floor(F.col("__hi") / width).cast("long")
    probe = probe.where(F.col("__lo") <= F.col("__hi")).withColumn(
        "__bucket", F.explode(F.sequence(first, last))
    )
    build = right.withColumn("__point", point.cast("long")).withColumn(
        "__bucket", F.floor(F.col("__point") / width).cast("long")
    )
    hit = F.col("__point").between(F.col("__lo"), F.col("__hi"))
    added = [c for c in right.columns if c not in keys]
    paired = probe.join(build, [*keys, "__bucket"]).where(hit).select(*left.columns, *added)
    if left_key is None:
        return paired
    lonely = left.join(paired.select(*left_key).distinct(), left_key, "left_anti")
    return paired.unionByName(lonely.select(*left.columns), allowMissingColumns=True)


def day_number(c: Column) -> Column:
    """Days since 1970, for use as a window point."""
    return F.unix_date(c)
