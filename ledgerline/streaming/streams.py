"""Streaming twins of the batch jobs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.dates import market_session
from ledgerline.session import ensure_checkpoint_dir
from ledgerline.sources.sinks import KeyedTable


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def open_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files under a path or pattern as a stream, schema from a batch read."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is available and return what it wrote."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    query = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append").start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def new_filings(stream: DataFrame, keys: Sequence[str], time: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """Each accession once, repeats within the watermark dropped."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(list(keys))


def insider_windows(
    stream: DataFrame, length: str = "30 days", slide: str | None = "1 day", watermark: str = "1 day", time: str = "ts"
) -> DataFrame:
    """Buys, sells and net shares per company in sliding or tumbling windows.

    Sliding windows are chained: trades are summed into panes of one slide
    first, and only the panes are dealt to the windows that hold them. A trade
    is expanded once, not once for each of 30 or 90 windows, and the state
    keeps a row per company and pane or window. ``length`` is a multiple of
    ``slide``.
    """
    buy, sell = F.col("transaction_type") == "Purchase", F.col("transaction_type") == "Sale"
    shares = F.col("shares").cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    out = stream.withWatermark(time, watermark).groupBy(F.window(time, slide or length).alias("window"), "cik").agg(
        F.count_if(buy).alias("buys"), F.count_if(sell).alias("sells"),
        F.sum(F.when(buy, shares).when(sell, -shares).otherwise(zero)).alias("net"),
    )
    if slide and slide != length:
        out = out.groupBy(F.window("window", length, slide).alias("window"), "cik").agg(
            F.sum("buys").alias("buys"), F.sum("sells").alias("sells"), F.sum("net").alias("net")
        )
    return out.select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "cik", "buys", "sells",
        F.col("net").cast("double").alias("net_shares"),
    )


def daily_bars(stream: DataFrame, watermark: str = "1 day", time: str = "ts", key: str = "symbol", value: str = "value") -> DataFrame:
    """Open, high, low, close and volume per key, day and market session."""
    df = stream.withWatermark(time, watermark).withColumn("session", market_session(time))
    out = df.groupBy(F.window(time, "1 day"), key, "session").agg(
        F.min_by(value, time).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"),
        F.max_by(value, time).alias("close"), F.count("*").alias("volume"),
    )
    return out.select(F.to_date("window.start").alias("day"), key, "session", "open", "high", "low", "close", "volume")


def upsert_stream(stream: DataFrame, path: str, keys: Sequence[str], state: str, order: Sequence[str] = (), buckets: int = 16) -> KeyedTable:
    """Feed a keyed table batch by batch; a batch that is run again leaves it unchanged."""
    table = KeyedTable(path, keys, order, buckets)
    query = (
        stream.writeStream.foreachBatch(lambda batch, epoch: table.write(batch, epoch))
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return table
