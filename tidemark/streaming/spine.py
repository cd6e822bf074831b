"""The lake's micro-batch: silver, gold and day buckets of counters, each batch under its own id, so that a retry replaces itself.

Nothing is rewritten: a batch adds its rows to each table, and readers merge. Gold is the latest of the batches' latest facts; counters are
sums of buckets of a day. A window of time is whole days of buckets and, at its ends, the rows of at most two days of
silver, which is laid out by day.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import DAY_MS
from tidemark.operators import ingest
from tidemark.operators.merging import latest_per_key
from tidemark.operators.reports import SEND

GOLD_KEYS = ["entityType", "entityId", "key"]
FACT = "entityType string, entityId string, key string, value string, valueType string, eventTs long, source string, factClass string, actionId string, channel string, day long"
BUCKET = "entityId string, channel string, day long, sent long, dropped long"
TABLES = {"silver": FACT, "gold": FACT, "buckets": BUCKET}

#: Days of a batch that are named in the scan of earlier silver; a batch of more days reads all of them.
NAMED_DAYS = 1_000


class BatchTables:
    """Parquet folders ``<table>/batch=<id>/day=<day>`` below one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in TABLES.items():
            spark.createDataFrame([], schema).drop("day").write.mode("ignore").parquet(f"{self.path}/{name}/batch=-1/day=-1")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.schema(f"{TABLES[table]}, batch long").option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}")

    def write(self, table: str, batch_id: int, df: DataFrame) -> None:
        df.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/{table}/batch={batch_id}")

    def gold(self) -> DataFrame:
        """The current fact of each key: the latest, of equal times the one of the later batch."""
        return latest_per_key(self.read("gold"), GOLD_KEYS, "eventTs", ["batch", "value"]).drop("batch", "day")


def fresh_facts(tables: BatchTables, facts: DataFrame, batch_id: int) -> DataFrame:
    """Facts that neither repeat in the batch nor in an earlier one; only the days of the batch are looked up."""
    keyed = facts.withColumn("day", F.expr(f"eventTs div {DAY_MS}")).dropDuplicates(["key", *SEND])
    days = [r[0] for r in keyed.select("day").distinct().limit(NAMED_DAYS + 1).collect()]
    before = tables.read("silver").where(F.col("batch") < batch_id)
    if len(days) <= NAMED_DAYS:
        before = before.where(F.col("day").isin([d for d in days if d is not None]))
    same = reduce(Column.__and__, [F.col(f"n.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("day", "key", *SEND)])
    return keyed.alias("n").join(before.alias("b"), same, "left_anti")


def process_facts(tables: BatchTables, emit: Callable[[DataFrame, int], None], now_ms: int, since: dict[str, int], week_ms: int, sent: str = "IN_PROCESS") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over facts with dimensions: adds them to all tables and emits the counters that they moved.

    A state of a contact moves its channel's level, a send (value ``sent``) its member's counts; ``emit`` gets (scope, id, key, n) of the
    channels and members that the batch touches, as they are now, and the batch's id.
    """

    def run(facts: DataFrame, batch_id: int) -> None:
        tables.write("silver", batch_id, fresh_facts(tables, facts, batch_id))
        new = tables.read("silver").where(F.col("batch") == batch_id).drop("batch")
        tables.write("gold", batch_id, latest_per_key(new, GOLD_KEYS, "eventTs", ["value"]))
        tables.write("buckets", batch_id, day_buckets(new))
        states = new.where("factClass = 'actionstate'")
        levels = channel_levels(tables, now_ms, since).join(states.select(F.col("channel").alias("id")).distinct(), "id", "left_semi")
        counts = member_counts(tables, now_ms, week_ms, sent).join(states.where(F.col("value") == sent).select(F.col("entityId").alias("id")).distinct(), "id", "left_semi")
        emit(levels.unionByName(counts), batch_id)

    return run


def process_batch(tables: BatchTables, emit: Callable[[DataFrame, int], None], now_ms: int, since: dict[str, int], week_ms: int) -> Callable[[DataFrame, int], None]:
    """The same over raw records (payload) in any of the sources' dialects."""
    run = process_facts(tables, emit, now_ms, since, week_ms)
    return lambda raw, batch_id: run(ingest.with_fact_dims(ingest.normalize_inbound(raw, default_ts=now_ms)), batch_id)


def day_buckets(facts: DataFrame) -> DataFrame:
    """entityId, channel, day, sent, dropped: what the states of a day add to the level of a channel and to a member's counts."""
    states = facts.where("factClass = 'actionstate'")
    return states.groupBy("entityId", "channel", "day").agg(F.count_if(F.col("value") == "IN_PROCESS").alias("sent"), F.count_if(F.col("value").isin("FAILED", "SUPPRESSED")).alias("dropped"))


def _inside(tables: BatchTables, from_ms: int, now_ms: int) -> DataFrame:
    """entityId, channel, sent, dropped of the time from ``from_ms`` to ``now_ms``: buckets of whole days, silver of the days at the ends."""
    first, last = -(-from_ms // DAY_MS), (now_ms + 1) // DAY_MS - 1  # whole days
    whole = tables.read("buckets").where(F.col("day").between(first, last)).select("entityId", "channel", "sent", "dropped")
    ends = sorted({d for d in (from_ms // DAY_MS, now_ms // DAY_MS) if not first <= d <= last})
    if not ends:
        return whole
    part = tables.read("silver").where(F.col("day").isin(ends) & F.col("eventTs").between(from_ms, now_ms))
    return whole.unionByName(day_buckets(part).drop("day"))


def channel_levels(tables: BatchTables, now_ms: int, since: dict[str, int]) -> DataFrame:
    """scope, id, key, n: sends less failed and suppressed ones of each channel from each time of ``since`` until now, not below 0."""
    frames = []
    for name, from_ms in since.items():
        n = F.greatest(F.lit(0).cast("long"), F.sum("sent") - F.sum("dropped"))
        frames.append(_inside(tables, from_ms, now_ms).groupBy(F.col("channel").alias("id")).agg(n.alias("n")).select(F.lit("channel").alias("scope"), "id", F.lit(name).alias("key"), "n"))
    return reduce(DataFrame.unionByName, frames)


def member_counts(tables: BatchTables, now_ms: int, week_ms: int, sent: str = "IN_PROCESS") -> DataFrame:
    """scope, id, key, n: a member's sends of the week for each channel and in total."""
    if sent != "IN_PROCESS":
        raise ValueError("buckets count IN_PROCESS as sent")
    inside = _inside(tables, now_ms - week_ms + 1, now_ms).where("sent > 0 AND entityId IS NOT NULL")
    counts = inside.rollup("entityId", "channel").agg(F.sum("sent").alias("n"), F.grouping("channel").alias("all")).where("entityId is not null")
    key = F.when(F.col("all") == 1, "operator.comms.totalThisWeek").otherwise(F.concat(F.lit("operator.comms."), "channel", F.lit("sThisWeek")))
    return counts.select(F.lit("member").alias("scope"), F.col("entityId").alias("id"), key.alias("key"), "n")


def rollover(tables: BatchTables, now_ms: int, since: dict[str, int], week_ms: int) -> DataFrame:
    """All counters at another time, for when the clock moved and no data came: days leave the window as buckets."""
    return channel_levels(tables, now_ms, since).unionByName(member_counts(tables, now_ms, week_ms))
