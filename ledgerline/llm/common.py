"""Small helpers that several corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import ensure_checkpoint_dir

# Words between ASCII white space, and words of letters, digits and non-ASCII characters.
SPACED = r"[^\x20\x09-\x0D]+"
WORDLIKE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """What runs inside drops its shuffle files when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder and read from there.

    Rows survive the loss of an executor, and what made them runs once however
    often they are used. The shuffles that led to them are not read again, so
    their files go at once.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with _freed(spark):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, in compressed columns, for tables that grow with the corpus.

    The files stay in the checkpoint folder, under the application's name.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    path = f"{sc.getCheckpointDir()}/{sc.applicationId}-{uuid.uuid4().hex}"
    with _freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def lowered(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; NULL becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def unsigned_hash_of_id(column: Column) -> Column:
    """crc32 of a value written as text."""
    return F.crc32(column.cast("string").cast("binary"))


def runs(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Cut sorted batches into one frame per key; only the open group is held."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        codes = batch[keys].ne(batch[keys].shift()).any(axis=1).to_numpy()
        codes[0] = True
        starts = [*codes.nonzero()[0], len(batch)]
        for a, b in zip(starts, starts[1:], strict=False):
            piece = batch.iloc[a:b]
            key = tuple(piece[keys].iloc[0])
            if held and key != last:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(piece)
            last = key
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
