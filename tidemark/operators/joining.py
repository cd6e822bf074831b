"""Joins in time and by identity. Joins in time are windows over the union of both sides: one shuffle, no pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_nba_id(df: DataFrame, idmap: DataFrame) -> DataFrame:
    return df.join(idmap.select("entityId", "nbaId"), "entityId", "left")


def member_id(entity_type: Column, entity_id: Column) -> Column:
    return F.concat(F.lit("nba_"), F.substring(F.sha2(F.concat_ws(":", entity_type, entity_id), 256), 1, 12))


def mint_ids(entities: DataFrame, idmap: DataFrame) -> DataFrame:
    """The id map with new entities added; an id depends on the entity only, so concurrent runs mint the same."""
    new = entities.select("entityType", "entityId").distinct().join(idmap, ["entityType", "entityId"], "left_anti")
    return idmap.unionByName(new.withColumn("nbaId", member_id(F.col("entityType"), F.col("entityId"))))


def lookup_identity(idmap: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the map for ids that may be either kind: two equi-joins instead of a join on an OR."""
    by_entity = wanted.join(idmap, wanted["anyId"] == idmap["entityId"])
    by_member = wanted.join(idmap, wanted["anyId"] == idmap["nbaId"])
    return by_entity.unionByName(by_member).distinct()


def asof_join(left: DataFrame, right: DataFrame, by: list[str], ts: str, right_ts: str, columns: list[str], strict: bool = False) -> DataFrame:
    """``left`` with ``right_ts`` and ``columns`` of the latest row of ``right`` at or before (``strict``: before) its ``ts``.

    Rows without a predecessor get nulls. Of several right rows of one time the greatest counts.
    """
    side = F.lit(0 if strict else 1)
    l_rows = left.select(*by, F.col(ts).alias("_at"), side.alias("_side"), F.lit(None).alias("_right"), F.struct(*left.columns).alias("_left"))
    payload = F.struct(right_ts, *columns)
    best = right.groupBy(*by, right_ts).agg(F.max(payload).alias("_right"))
    r_rows = best.select(*by, F.col(right_ts).alias("_at"), F.lit(1 if strict else 0).alias("_side"), "_right", F.lit(None).alias("_left"))
    order = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l_rows.withColumn("_right", F.col("_right").cast(best.schema["_right"].dataType)).unionByName(r_rows.withColumn("_left", F.col("_left").cast(l_rows.schema["_left"].dataType)))
    found = both.withColumn("_found", F.last("_right", ignorenulls=True).over(order)).where("_left is not null")
    return found.select("_left.*", *(F.col(f"_found.{c}").alias(c) for c in (right_ts, *columns)))


def asof_features(decisions: DataFrame, snapshots: DataFrame, by: list[str], ts: str, snap_ts: str, columns: list[str]) -> DataFrame:
    """Point-in-time features: decisions without an earlier snapshot are left out."""
    return asof_join(decisions, snapshots, by, ts, snap_ts, columns).where(F.col(snap_ts).isNotNull())


def with_next(df: DataFrame, by: list[str], ts: str, into: str) -> DataFrame:
    return df.withColumn(into, F.lead(ts).over(Window.partitionBy(*by).orderBy(ts)))


def episode_states(sends: DataFrame, states: DataFrame, by: list[str], ts: str = "decisionTs", state_ts: str = "stTs") -> DataFrame:
    """States with the contact they belong to: the last one of ``by`` at or before them, until the next.

    The interval join needs no range predicate: a state's interval is that of the last send before it.
    """
    return asof_join(states, sends, by, state_ts, ts, ["correlationId"]).where(F.col(ts).isNotNull())


def holds(evaluations: DataFrame, sends: DataFrame) -> DataFrame:
    """Evaluations that led to no contact."""
    return evaluations.join(sends.select("correlationId").distinct(), "correlationId", "left_anti")


def attach_propensity(examples: DataFrame, log: DataFrame, keys: list[str], default: float = 0.5) -> DataFrame:
    """Logged propensities, averaged over repeated log rows; ``default`` where none was logged."""
    once = log.groupBy(*keys).agg(F.avg("propensity").alias("propensity"))
    return examples.join(once, keys, "left").withColumn("propensity", F.coalesce("propensity", F.lit(default)))


def orphan_activations(activations: DataFrame, evaluations: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct activated tuples that were never eligible."""
    return activations.select(keys).distinct().join(evaluations.select(keys).distinct(), keys, "left_anti")


def scope_to(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def merge_layers(layers: list[DataFrame], by: list[str]) -> DataFrame:
    """One value for each ``by`` and key from layers of (by, key, value, eventTs): the latest, of equals the later layer's."""
    ranked = [d.select(*by, "key", "value", "eventTs", F.lit(i).alias("layer")) for i, d in enumerate(layers)]
    both = reduce(DataFrame.unionByName, ranked)
    return both.groupBy(*by, "key").agg(F.max_by(F.struct("value", "eventTs", "layer"), F.struct("eventTs", "layer", "value")).alias("r")).select(*by, "key", "r.*")


def overlay_profile(points: DataFrame, profile: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Points with the current profile's ``columns``, 0 where a member has none."""
    joined = points.join(profile.select(key, *columns), key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})


def hop_latency(events: DataFrame, upstream: DataFrame, by: list[str], max_ms: int) -> DataFrame:
    """Events with the time since the last upstream event of the same entity, where that is at most ``max_ms``."""
    found = asof_join(events, upstream, by, "ts", "upTs", [])
    return found.where(F.col("upTs").isNotNull() & (F.col("ts") - F.col("upTs") <= max_ms)).withColumn("latency", F.col("ts") - F.col("upTs"))


def trace(correlation: DataFrame, activations: DataFrame, evaluations: DataFrame, dispositions: DataFrame) -> DataFrame:
    """For each wanted correlationId one row with its ordered steps (ts, kind, actionId, channel, detail)."""
    def steps(df: DataFrame, kind: str, ts: str, detail: str) -> DataFrame:
        return df.join(correlation, "correlationId", "left_semi").select("correlationId", F.struct(F.col(ts).alias("ts"), F.lit(kind).alias("kind"), "actionId", "channel", F.col(detail).cast("string").alias("detail")).alias("step"))

    every = steps(activations, "activation", "ts", "op").unionByName(steps(evaluations, "evaluation", "evaluatedAt", "eligible")).unionByName(steps(dispositions, "disposition", "eventTs", "raw"))
    return every.groupBy("correlationId").agg(F.array_sort(F.collect_list("step")).alias("steps"))
