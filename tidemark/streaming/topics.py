"""File twins of keyed topics: publish a table as a topic, read it as a stream, drain it.

A topic is a folder of Parquet files that arrive in steps of event time. All rows of a key that arrive in a step are in one file,
so a micro-batch, whatever number of files it takes, sees them together; between the files of a step event time may go back by
the step's width, which is the watermark's delay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources import streams
from tidemark.workspace import materialise, shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Topic:
    """A folder with its rows' schema, the column of event time (epoch milliseconds) and how far it may go back."""

    path: str
    schema: StructType
    ts: str
    delay_ms: int

    def stream(self, spark: SparkSession, max_files: int = 100) -> DataFrame:
        """The topic as a stream with event time ``at`` and its watermark."""
        rows = streams.read_files(spark, self.path, self.schema, max_files)
        return rows.withColumn("at", F.timestamp_millis(self.ts)).withWatermark("at", f"{self.delay_ms} milliseconds")


def publish(df: DataFrame, name: str, keys: list[str], ts: str = "ts", steps: int = 3, idle_ms: int = 0) -> Topic:
    """Write ``df`` as a topic that arrives in ``steps`` of equal width in time; rows of equal ``keys`` share a step's file.

    ``idle_ms`` ends the topic with a heartbeat: a row (keys 0, else nulls) so long after the last step that all timers due within that
    time fire. Times are after the epoch's first millisecond, where watermarks start. Rows without a time are left out, as a broker stamps every record. An empty table makes a topic without files but the heartbeat.
    """
    spark, rows = df.sparkSession, materialise(df.where(F.col(ts).isNotNull()), f"{name}-rows")
    first, last = rows.agg(F.min(ts), F.max(ts)).first()
    first, last = first or 0, last or 0
    width = (last - first) // steps + 1
    topic = Topic(new_folder(spark, name), rows.schema, ts, width)
    for step in range(steps):
        begin = first + step * width
        rows.where((F.col(ts) >= begin) & (F.col(ts) < begin + width)).repartition(*keys).write.mode("append").parquet(topic.path)
    if idle_ms:
        # Keys are not null, for filters on them run before the watermark and would take the heartbeat away.
        values = {ts: F.lit(last + 2 * width + idle_ms)} | {k: F.lit("0") for k in keys}
        beat = spark.range(1).select([values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
        beat.write.mode("append").parquet(topic.path)
    return topic


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which keyed state with maps and timers needs."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def drain(df: DataFrame, name: str) -> DataFrame:
    """What a stream appends until its input is used up, as a table. Batches are written under their ids, so a retried one replaces itself."""
    spark = df.sparkSession
    out = new_folder(spark, name)
    streams.run_available_now(df, new_folder(spark, f"{name}-checkpoint"), streams.idempotent_batch(spark, out, streams.overwrite_parquet))
    return spark.read.schema(df.schema).option("basePath", out).option("recursiveFileLookup", "true").parquet(out)
