"""A stream of events with definitions that change: a control stream fills a table of versions, and an event meets the one of its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources import streams
from tidemark.streaming import topics

VERSION = "id string, updatedTs long, name string, ttlSeconds long"


def versions(definitions: DataFrame) -> DataFrame:
    """id, name, ttlSeconds, validFrom, validTo (null: still valid) of each version; a null name ends a definition (tombstone).

    Repeated versions count once; of versions of one time the one with the largest name and time to live holds, a tombstone least.
    """
    each = definitions.where("id IS NOT NULL AND updatedTs IS NOT NULL").groupBy("id", "updatedTs").agg(F.max(F.struct("name", "ttlSeconds")).alias("d")).select("id", "updatedTs", "d.*")
    until = F.lead("updatedTs").over(Window.partitionBy("id").orderBy("updatedTs"))
    return each.select("id", "name", "ttlSeconds", F.col("updatedTs").alias("validFrom"), until.alias("validTo")).where("name is not null")


def with_definitions_at(events: DataFrame, known: DataFrame, ts: str = "ts") -> DataFrame:
    """Events (actionId, ``ts``) with name and ttlSeconds as they were at their time; without a valid definition an event is left out.

    ``known``: versions with their validity. Definitions are authored by people; Spark broadcasts them by their size, so that events of
    a frequent action stay where they are, and joins by id, split on skew, where they are too many.
    """
    v = known.select(F.col("id").alias("_id"), "name", "ttlSeconds", "validFrom", "validTo")
    valid = (F.col("actionId") == F.col("_id")) & (F.col(ts) >= F.col("validFrom")) & (F.col("validTo").isNull() | (F.col(ts) < F.col("validTo")))
    return events.join(v, valid).drop("_id", "validFrom", "validTo")


class DefinedEvents:
    """Versions and events below one path; each drain goes on from its checkpoint, each batch is written under its id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], VERSION).write.mode("ignore").parquet(f"{self.path}/versions/batch=-1")

    def versions(self) -> DataFrame:
        rows = self.spark.read.schema(VERSION).option("recursiveFileLookup", "true").parquet(f"{self.path}/versions")
        return versions(rows)

    def drain_control(self, control: DataFrame) -> None:
        """New versions and tombstones (``VERSION``) into the table of versions."""
        rows = control.select([f.split()[0] for f in VERSION.split(", ")])
        streams.run_available_now(rows, f"{self.path}/control-checkpoint", streams.idempotent_batch(self.spark, f"{self.path}/versions", streams.overwrite_parquet))

    def drain_events(self, events: DataFrame, ts: str = "ts") -> DataFrame:
        """Events so far with their definitions. Each batch reads the table anew, so what the control stream brought in between holds."""
        def join(df: DataFrame, path: str) -> None:
            with_definitions_at(df, self.versions(), ts).write.mode("overwrite").parquet(path)

        streams.run_available_now(events, f"{self.path}/events-checkpoint", streams.idempotent_batch(self.spark, f"{self.path}/events", join))
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/events")
