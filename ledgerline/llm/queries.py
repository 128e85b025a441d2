"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (
    alignment,
    chat,
    decontam,
    divergence,
    licenses,
    mixing,
    neighbours,
    pages,
    repeats,
    reshard,
    simhash,
    toxicity,
    vectors,
)
from ledgerline.llm.common import fresh_folder, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


ORACLES["op4_licenses"] = licenses.ORACLE


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and how many words of it each output shard gets."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                        F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"),
                        mixing.shard_words().alias("shard_words"))


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of one made of control strings, read back from their format."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        f"SELECT * FROM VALUES (-1L, 0L, 'user', '{chat.PROBE}'), (-1L, 1L, 'assistant', '{chat.PROBE}') AS t(conv_id, turn, role, text)"
    )
    return chat.digests(chat.reconstruct(chat.turn_events(given.union(probe))))


ORACLES["op6_chat"] = chat.ORACLE


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents moved from five shards, filled by source, to eight of equal counts; affected files written and read back."""
    docs = table(spark, sf_dir, "documents")
    old = F.pmod(F.xxhash64("source"), F.lit(5))
    placed = reshard.rewritten(docs, old, 8, fresh_folder(spark, "shards"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


@query
def op10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = pages.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items they contain."""
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op2_decontamination"] = decontam.ORACLE


@query
def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of all documents without repeated strings of 200 bytes."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every twentieth embedding."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers' tokens of all documents meet."""
    return alignment.align(table(spark, sf_dir, "documents"))


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language diverge."""
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op13_divergence"] = divergence.ORACLE
