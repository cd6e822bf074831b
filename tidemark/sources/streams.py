"""Streaming sources and sinks: message topics where a broker is there, the same tables as files elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_topics(spark: SparkSession, servers: str, topics: list[str], start: str = "latest", max_per_trigger: int = 100_000) -> DataFrame:
    """Topics with headers in capped micro-batches; lost offsets do not stop the job. ``start``: earliest for replays, latest for events."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "includeHeaders": "true", "startingOffsets": start, "maxOffsetsPerTrigger": str(max_per_trigger), "failOnDataLoss": "false"}
    return spark.readStream.format("kafka").options(**options).load()


# Where a job that has no checkpoint yet begins to read.
ENTRY = {"config": "earliest", "replay": "earliest", "events": "latest"}


def read_by_policy(spark: SparkSession, servers: str, topics: list[str], kind: str, max_per_trigger: int = 100_000) -> DataFrame:
    """Topics of a kind (``ENTRY``): all of configuration and replays, of events what comes from now on; a checkpoint goes before either."""
    return read_topics(spark, servers, topics, ENTRY[kind], max_per_trigger)


def reset(spark: SparkSession, tables: list[str], folders: list[str]) -> None:
    """Full reset: empties the tables and removes the folders (checkpoints, file tables), so that the next drain reads from the entry offset.

    Tables go first: a job that dies in between has its checkpoint and adds to empty tables, and a second reset ends it. What is missing is
    no error.
    """
    for name in tables:
        if spark.catalog.tableExists(name):
            spark.sql(f"TRUNCATE TABLE {name}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in folders:
        path = hadoop.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_files(spark: SparkSession, path: str, schema: StructType | str, max_files: int = 100) -> DataFrame:
    """The file twin of a topic: new Parquet files of a folder, a bounded number in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def write_facts(df: DataFrame, servers: str, topic: str) -> None:
    """Facts (entityType, entityId, json) to a topic with the ``origin`` header that keeps the lake from reading them back."""
    header = F.array(F.struct(F.lit("origin").alias("key"), F.lit("lake").cast("binary").alias("value")))
    rows = df.select(F.concat_ws(":", "entityType", "entityId").alias("key"), F.col("json").alias("value"), header.alias("headers"))
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", "true").option("topic", topic).save()


def write_topic_files(df: DataFrame, path: str) -> None:
    """The file twin of a sink: Parquet by topic."""
    df.write.mode("append").partitionBy("topic").parquet(path)


def idempotent_batch(spark: SparkSession, path: str, write: Callable[[DataFrame, str], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each batch under its id: a retried batch replaces its own output and nothing else."""
    def run(df: DataFrame, batch_id: int) -> None:
        write(df, f"{path}/batch={batch_id}")

    return run


def overwrite_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def run_available_now(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Drain what is there in micro-batches and stop; the next call goes on from the checkpoint."""
    query = df.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()
    query.awaitTermination()
    return query


def run_continuously(stream: Callable[[], DataFrame], checkpoint: str, each: Callable[[DataFrame, int], None], drains: int, pause: Callable[[Exception | None], None] = lambda e: None) -> int:
    """Drain again and again from one checkpoint; a drain that fails is taken up by the next one where it was. Returns how many failed.

    ``stream`` gives the input anew for each drain, so that a source that could not be reached is connected again; ``pause`` is called between drains
    with what went wrong, or None.
    """
    failed = 0
    for _ in range(drains):
        error: Exception | None = None
        try:
            run_available_now(stream(), checkpoint, each)
        except StreamingQueryException as e:
            failed, error = failed + 1, e
        pause(error)
    return failed


def dedup_ingress(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Without repeats that arrive within ``delay``; the watermark lets old state go."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def live_metrics(stream: DataFrame, ts: str, width: str, delay: str) -> DataFrame:
    """Events by tumbling window and channel, closed by the watermark."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width), "channel").agg(F.count(F.lit(1)).alias("events"))
