"""A training corpus in five stages: clean, deduplicate, decontaminate, mix and shard.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm import decontam, mixing, reshard, simhash, toxicity
from ledgerline.llm.common import cut, table, written
from ledgerline.operators.ranking import rank_within
from ledgerline.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
OLD_SHARDS = 5
NEW_SHARDS = 8


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number per row: rows stay apart even where ids repeat or are NULL."""
    return docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id())


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; NULL and empty texts stay."""
    scored = toxicity.score(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(*COLUMNS)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group alike in 0.8 of its five-word shingles: the smallest id, NULL last.

    Links come from SimHash fingerprints (bit counts of their segments on a grid
    of band pairs, Manhattan and then exact distance), are verified exactly and
    completed by those that two bits of 64 do not reach.
    """
    rows = _numbered(docs)
    near = simhash.near_duplicates(rows, words=5, id="row")
    groups = simhash.similar_groups(rows, words=5, similarity=0.8, id="row", near=near)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = groups.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col("first.row").alias("row")), "row", "left_semi").select(*COLUMNS)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 0.8 of its five-word shingles."""
    rows = _numbered(docs)
    leaks = decontam.contained(rows, table(spark, sf_dir, "benchmark"), id="row").select("row").distinct()
    return rows.join(leaks, "row", "left_anti").select(*COLUMNS)


def _side_table(keys: DataFrame) -> str:
    """Where the shards and places of a mix lie: a folder named after the rows (``key``) that the mix gave.

    Whoever has the rows finds it, also another process or a restarted driver.
    """
    spark = keys.sparkSession
    n, x, s = keys.agg(F.count("*"), F.bit_xor("key"), F.sum(F.pmod("key", F.lit(1_000_003)))).first()
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base}/mix-{n}-{x or 0}-{s or 0}"


def _keyed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with a key of the columns of documents (in ``key``), and copy, which tells equal rows apart."""
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy(*order)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row per document, pass and output shard.

    The shard and the place in its shuffled order are kept in a side table, as
    the columns of this stage are fixed; the next stage finds it by its rows.
    """
    mix = mixing.mix(docs.select(*COLUMNS), shards=NEW_SHARDS)
    taken = written(
        mixing.taken_texts(mix, by_shard=True).withColumn("n_chars", F.length("text").cast("long"))
        .select(*COLUMNS, "mix_shard", "mix_place", F.xxhash64(*COLUMNS).alias("key"))
    )
    dealt = _keyed(taken.select("key", "mix_shard", "mix_place"), "mix_shard", "mix_place")
    dealt.write.mode("overwrite").parquet(_side_table(taken.select("key")))
    return taken.select(*COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows moved from the mix's shards to eight of equal counts, in the mix's shuffled order: shard, slot and moved.

    Rows that no mix dealt come from five shards, filled by source, and are
    shuffled by a hash.
    """
    rows = _numbered(docs)
    sizes = _keyed(rows.select("source", *reshard.measures("row", "text"), F.xxhash64(*COLUMNS).alias("key")), "row")
    try:
        dealt = spark.read.parquet(_side_table(sizes.select("key")))
    except AnalysisException:  # no such folder
        dealt = spark.createDataFrame([], "key long, copy int, mix_shard int, mix_place long")
    sizes = sizes.join(dealt, ["key", "copy"], "left")
    by_source = F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS))
    sizes = cut(sizes.withColumn("old", F.coalesce("mix_shard", by_source)).withColumn("place", F.coalesce("mix_place", "tie")))
    placed = reshard.reshard(sizes, F.col("old"), NEW_SHARDS).drop("slot")
    placed = rank_within(placed, ["shard"], [F.col("place"), F.col("tie"), F.col("row")], "at").withColumn("slot", F.col("at") - 1)
    kept = placed.select("row", "size", "text_crc32", "old_shard", "shard", "slot", "moved")
    return rows.join(kept, "row").drop("row")


STAGES = [
    ("toxicity", toxic_out),
    ("near duplicates", near_copies_out),
    ("decontamination", leaks_out),
    ("mixing", mixed),
    ("sharding", sharded),
]

# A trained classifier and hashed draws have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
