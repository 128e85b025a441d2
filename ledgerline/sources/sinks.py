"""Exports and keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str) -> None:
    """Export rows as CSV part files with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def company_documents(wide: DataFrame, groups: dict[str, Sequence[str]], keys: Sequence[str] = ("cik",)) -> DataFrame:
    """One nested JSON document per row, metric columns grouped under names."""
    parts = [F.struct(*[F.col(c) for c in cols]).alias(name) for name, cols in groups.items()]
    return wide.select(*keys, F.to_json(F.struct(*keys, *parts)).alias("json"))


def write_json(docs: DataFrame, path: str) -> None:
    docs.select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def comparison_snapshot(long: DataFrame, metrics: Sequence[str], key: str = "ticker") -> DataFrame:
    """The chosen metrics of each company packed into one row."""
    cells = F.collect_list(F.struct("metric", "value"))
    rows = long.where(F.col("metric").isin(*metrics)).groupBy(key, "fy").agg(F.array_sort(cells).alias("metrics"))
    return rows


def latest_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last version of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def upsert(table: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Table rows replaced or extended by the updates."""
    kept = table.join(updates.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(updates)


def _has_files(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet files under a path, None where there are none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


class SnapshotSink:
    """Snapshots appended under a batch name; a batch that is appended again replaces itself."""

    def __init__(self, path: str):
        self.path = path

    def append(self, rows: DataFrame, batch: str) -> None:
        named = rows.withColumn("batch", F.lit(batch))
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).withColumn("batch", F.col("batch").cast("string"))


class KeyedTable:
    """One row per key, in buckets by key; an upsert rewrites only the buckets it touches.

    Each key lies in the bucket of its hash, a partition folder. A write merges
    its rows with those buckets, puts the result aside and then replaces the
    buckets (dynamic partition overwrite), so a read touches one version of each
    row. Of several rows of a key the highest in ``order`` stays, with all
    other columns as the tie break; batches may come in any order, and one that
    is written again, even after it was cut short between the two steps, leaves
    the same table. The number of buckets is fixed when a table is made.
    """

    def __init__(self, path: str, keys: Sequence[str], order: Sequence[str] = (), buckets: int = 16):
        self.path, self.keys, self.order, self.buckets = path, list(keys), list(order), buckets

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = sorted(c for c in rows.columns if c not in (*self.keys, *self.order, "bucket", "__new"))
        return latest_wins(rows, self.keys, [F.col(c).desc_nulls_last() for c in (*self.order, "__new", *rest)]).drop("__new")

    def write(self, rows: DataFrame, version: int) -> None:
        """Upsert ``rows``; ``version`` names the batch. Without an order, later batches win."""
        spark = rows.sparkSession
        aside = f"{self.path}/_aside/version={version}"
        done = _has_files(spark, f"{aside}/done")
        if done is None:
            bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
            fresh = rows.withColumns({"bucket": bucket, "__new": F.lit(1)})
            table = _has_files(spark, self.path)
            if table is not None:
                # At most as many numbers as there are buckets; they prune the read to those folders.
                touched = [r[0] for r in fresh.select("bucket").distinct().collect()]
                held = table.where(F.col("bucket").isin(touched)).withColumn("__new", F.lit(0))
                fresh = fresh.unionByName(held)
            self._latest(fresh).write.mode("overwrite").parquet(f"{aside}/rows")
            spark.range(1).write.mode("overwrite").parquet(f"{aside}/done")
        merged = spark.read.parquet(f"{aside}/rows").repartition("bucket")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("bucket")
