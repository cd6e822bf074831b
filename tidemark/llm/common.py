"""Helpers that several of the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word: any run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: The most rows a table may have to be broadcast; each such table has rows of bounded width.
BROADCAST_ROWS = 100_000


def lower_ascii(text: Column) -> Column:
    """``text`` with only A-Z lower-cased. Pure ASCII texts take Spark's much faster ``lower``, which is the same for them."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; beyond that Spark plans an ordinary join, split on skew."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextmanager
def arrow_batches(spark: SparkSession, most_bytes: int = 8 << 20) -> Iterator[None]:
    """Tasks that start inside pass at most so many bytes to Python at once, whatever the length of the texts (but for one text)."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(most_bytes))
    try:
        yield
    finally:
        spark.conf.set(setting, before)
