"""Writing rules of the lake as functions of two tables: what is there and what comes in. They return the table to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def append_dedup(incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: one for each key of the batch, the least of those that differ, so that reruns agree."""
    rest = [c for c in incoming.columns if c not in keys]
    picked = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")) if rest else incoming.distinct()
    return picked.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(incoming.columns) if rest else picked


def merge_insert_only(table: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert if absent: what is there stays for ever."""
    return table.unionByName(incoming.join(table, _same(incoming, table, keys), "left_anti"))


def merge_all(table: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or overwrite on the key."""
    return table.join(incoming, _same(table, incoming, keys), "left_anti").unionByName(incoming)


def merge_if_changed(table: DataFrame, incoming: DataFrame, keys: list[str], column: str, stamp: str) -> DataFrame:
    """Insert or overwrite on the key, but a row whose ``column`` is the same keeps its old ``stamp``."""
    old = table.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(column).alias("_was"), F.col(stamp).alias("_stamp"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = incoming.join(old, on, "full")
    kept = F.col(keys[0]).isNull() | F.col(column).eqNullSafe(F.col("_was"))
    out = [F.coalesce(k, f"_{k}").alias(k) for k in keys]
    return both.select(*out, F.when(kept, F.col("_was")).otherwise(F.col(column)).alias(column), F.when(kept & F.col("_stamp").isNotNull(), F.col("_stamp")).otherwise(F.col(stamp)).alias(stamp))


def latest_per_key(df: DataFrame, keys: list[str], ts: str, ties: list[str] = ()) -> DataFrame:
    """The row of latest ``ts`` for each key; of several the greatest by ``ties``, then by its other columns.

    An aggregate, so a hot key is reduced before it is shuffled, and no key is sorted.
    """
    rest = [c for c in df.columns if c not in keys and c != ts and c not in ties]
    best = df.groupBy(*keys).agg(F.max(F.struct(ts, *ties, *rest)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in (ts, *ties, *rest))).select(df.columns)


def merge_lww(table: DataFrame, incoming: DataFrame, keys: list[str], ts: str = "eventTs", value: str = "value") -> DataFrame:
    """Last writer wins: the row of latest ``ts`` stays, of equally late ones the incoming, then the greatest value."""
    ranked = table.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest_per_key(ranked, keys, ts, ["_new", value]).drop("_new")


def latest_and_history(df: DataFrame, ts: str) -> tuple[DataFrame, DataFrame]:
    """(the one latest row, all rows): a latest-only table and its append-only history."""
    latest = df.agg(F.max(F.struct(ts, *[c for c in df.columns if c != ts])).alias("r")).where("r is not null")
    return latest.select(*(F.col(f"r.{c}").alias(c) for c in df.columns)), df


def changed_only(before: DataFrame, after: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Rows of ``after`` that are new or whose value differs from ``before``."""
    old = before.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(value).alias("_was"), F.lit(True).alias("_there"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = after.join(old, on, "left").where(F.col("_there").isNull() | ~F.col(value).eqNullSafe(F.col("_was")))
    return both.select(after.columns)


def read_changes(before: DataFrame | None, after: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The change feed between two versions of a table; with no version before, all of it."""
    return after if before is None else changed_only(before, after, keys, value)


def medallion(bronze: DataFrame, ids: list[str], spec: list[tuple[str, str, str]], ts: str = "eventTs") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(silver, facts, gold): deduplicated rows, their facts, and the latest fact for each entity and key."""
    from tidemark.operators.ingest import melt_facts

    silver = bronze.dropDuplicates()
    facts = melt_facts(silver, [*ids, ts], spec)
    return silver, facts, latest_per_key(facts, [*ids, "key"], ts, ["value"])


def export_columns(df: DataFrame) -> DataFrame:
    """For a serving database: lower-case names, maps and arrays as JSON text."""
    def flat(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        return (F.to_json(c) if kind.startswith(("map", "array", "struct")) else c).alias(name.lower())

    return df.select(*(flat(n, k) for n, k in df.dtypes))


def export_jdbc(df: DataFrame, url: str, name: str, properties: dict | None = None) -> None:
    export_columns(df).write.jdbc(url, name.lower(), mode="overwrite", properties=properties or {})


def with_chunk_id(df: DataFrame, key: str, chunks: int) -> DataFrame:
    """Deals rows into ``chunks`` parts of nearly one size, by a hash of ``key``: a trickle of writes in a stable random order."""
    return df.withColumn("chunk", F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(chunks)))


def sink_name(name: str, shadow: bool) -> str:
    """Where a job writes: beside the real table when it runs as a shadow."""
    return f"{name}_shadow" if shadow else name


# Columns of the lake's tables.
SCHEMAS = {
    "silver_fact_history": "entityType STRING, entityId STRING, key STRING, value STRING, valueType STRING, eventTs BIGINT, source STRING, topic STRING, factClass STRING, actionId STRING, channel STRING, scoreVal DOUBLE, contentKey STRING, ingestTs TIMESTAMP",
    "silver_eval_eligible": "nbaId STRING, actionId STRING, channel STRING, name STRING, evaluatedAt BIGINT, correlationId STRING, ingestTs TIMESTAMP",
    "silver_activations": "nbaId STRING, entityType STRING, entityId STRING, op STRING, actionId STRING, channel STRING, name STRING, score DOUBLE, source STRING, eventTs BIGINT, correlationId STRING, contentKey STRING, ingestTs TIMESTAMP",
    "silver_snapshots": "nbaId STRING, entityType STRING, entityId STRING, updatedTs BIGINT, factCount BIGINT, correlationId STRING, factsJson STRING, ingestTs TIMESTAMP",
    "silver_milestones": "nbaId STRING, milestoneId STRING, name STRING, completedAt BIGINT, ingestTs TIMESTAMP",
    "gold_member_idmap": "entityType STRING, entityId STRING, nbaId STRING, updatedTs TIMESTAMP",
    "gold_member_snapshot": "entityType STRING, entityId STRING, nbaId STRING, key STRING, value STRING, valueType STRING, eventTs BIGINT, source STRING",
    "dim_definitions": "id STRING, defType STRING, name STRING, channel STRING, ttlSeconds BIGINT, hardTtlSeconds BIGINT, autoExclude BOOLEAN, channelsJson STRING, inclusionJson STRING, exclusionJson STRING, logicJson STRING, completionJson STRING, factsUsedJson STRING, updatedTs BIGINT",
    "predictions_log": "nbaId STRING, actionId STRING, channel STRING, correlationId STRING, base_score DOUBLE, emit_score DOUBLE, propensity DOUBLE, temperature DOUBLE, evaluatedAt BIGINT, scoredAt TIMESTAMP",
    "quarantine": "consumer STRING, topic STRING, partition INT, offset BIGINT, key STRING, value STRING, headers MAP<STRING, STRING>, error STRING, dlqTs BIGINT",
}


def ensure_tables(spark: SparkSession, namespace: str, shadow: bool = False) -> list[str]:
    """Creates the namespace and its empty typed tables where they are missing; returns their names."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {namespace}")
    names = [f"{namespace}.{sink_name(n, shadow)}" for n in SCHEMAS]
    for name, columns in zip(names, SCHEMAS.values(), strict=True):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")
    return names
