"""Ordered work inside a key: trailing counts, touches, transitions, debounce, admission, settling; batch twins of the stateful streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import DAY_MS, next_midnight


def trailing_counts(df: DataFrame, ts: str, days: int, counts: dict[str, list[str]]) -> DataFrame:
    """Adds for each name of ``counts`` how many rows of the same keys lie in the ``days`` before, the row's own time excluded."""
    frames = {n: Window.partitionBy(*keys).orderBy(ts).rangeBetween(-days * DAY_MS, -1) for n, keys in counts.items()}
    return df.withColumns({n: F.count(F.lit(1)).over(w) for n, w in frames.items()})


def days_since_contact(df: DataFrame, by: list[str], ts: str, days: int, default: float) -> DataFrame:
    """Adds daysSinceLastContact: days since the last row of ``by`` within ``days``, else ``default``."""
    frame = Window.partitionBy(*by).orderBy(ts).rangeBetween(-days * DAY_MS, -1)
    return df.withColumn("daysSinceLastContact", F.coalesce((F.col(ts) - F.max(ts).over(frame)) / DAY_MS, F.lit(default)))


def touch_template(sends: DataFrame, by: list[str], ts: str, keys: Column, base: Column, ties: list[str]) -> DataFrame:
    """Adds touch (1, 2, ... for each ``by`` over all time) and template: the touch's key, the last one from then on; no keys: ``base``."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(ts, *ties))
    known = F.coalesce(F.size(keys), F.lit(0))
    template = F.when(known > 0, F.try_element_at(keys, F.least(n, known))).otherwise(base)
    return sends.withColumns({"touch": n, "template": template})


def debounce_verdict(instances: DataFrame, by: list[str]) -> DataFrame:
    """Adds verdict for CREATED instances among the siblings of ``by``: LOSE, WAIT or SEND.

    Lose where a sibling is PRESENTED or DECLINED, or a CREATED one scores higher (ties: the smaller slug wins); wait where
    one is IN_PROCESS or SUPPRESSING. Aggregates over the siblings and one comparison, no pairs.
    """
    own = Window.partitionBy(*by)
    slug = F.concat_ws("::", "actionId", "channel")
    created = F.col("state") == "CREATED"
    best = F.min(F.when(created, F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("s"), slug.alias("slug")))).over(own)
    settled = F.max(F.col("state").isin("PRESENTED", "DECLINED")).over(own)
    busy = F.max(F.col("state").isin("IN_PROCESS", "SUPPRESSING")).over(own)
    verdict = F.when(settled | (best["slug"] != slug), "LOSE").when(busy, "WAIT").otherwise("SEND")
    return instances.withColumn("verdict", F.when(created, verdict))


def admit_batch(sends: DataFrame, caps: dict[str, int], window_ms: int, ts: str, ties: list[str]) -> DataFrame:
    """Adds decision (SEND or HOLD): the first sends of each channel and fixed window up to the channel's cap; uncapped ones all.

    ``ties`` tells sends of one time apart; sends that agree in it too are admitted together. Of each window only its first sends, as
    many as the largest cap, are ranked, and Spark drops the others before they are shuffled; the last one admitted
    is then the bound for all, so no task holds a busy channel.
    """
    order = [ts, *ties]
    cap = F.coalesce(F.lit(None).cast("int"), *[F.when(F.col("channel") == c, F.lit(n)) for c, n in caps.items()])
    dated = sends.withColumn("_window", F.col(ts) - F.pmod(F.col(ts), F.lit(window_ms))).withColumn("_cap", cap)
    place = F.row_number().over(Window.partitionBy("channel", "_window").orderBy(*order))
    first = dated.where("_cap is not null").select("channel", "_window", "_cap", *order).withColumn("_place", place).where(F.col("_place") <= max(caps.values(), default=0))
    bounds = first.where(F.col("_place") <= F.col("_cap")).groupBy("channel", "_window").agg(F.max(F.struct(*order)).alias("_bound"))
    held = dated.join(bounds, ["channel", "_window"], "left")
    admitted = F.col("_cap").isNull() | F.coalesce(F.struct(*order) <= F.col("_bound"), F.lit(False))
    return held.withColumn("decision", F.when(admitted, "SEND").otherwise("HOLD")).select(*sends.columns, "decision")


def settle_batches(creates: DataFrame, by: list[str], ts: str, gap_ms: int, payload: str) -> DataFrame:
    """One row for each run of batches with gaps of less than ``gap_ms``: firstTs, lastTs, batches and the latest ``payload``.

    Sessions are counted by a window instead of ``session_window``, so that times stay epoch milliseconds.
    """
    order = Window.partitionBy(*by).orderBy(ts, payload)
    new = F.coalesce((F.col(ts) - F.lag(ts).over(order)) >= gap_ms, F.lit(True)).cast("int")
    run = creates.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*by, "_run").agg(F.min(ts).alias("firstTs"), F.max(ts).alias("lastTs"), F.count(F.lit(1)).alias("batches"), F.max_by(payload, F.struct(ts, payload)).alias(payload)).drop("_run")


def drop_stale(dispositions: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """Dispositions of the live run only; those of another run are ignored, signals without a correlation id are not gated."""
    live = runs.select(*by, F.col("correlationId").alias("_live"))
    return dispositions.join(live, by, "left").where(F.col("correlationId").isNull() | F.col("correlationId").eqNullSafe(F.col("_live"))).drop("_live")


def fold_snapshots(facts: DataFrame, by: list[str]) -> DataFrame:
    """The member snapshot document by last writer wins: factCount, updatedTs, factsJson, correlationId. Batch twin of the stream."""
    latest = facts.groupBy(*by, "key").agg(F.max(F.struct("eventTs", "value", "valueType")).alias("f"))
    entry = F.struct("key", F.struct(F.col("f.value").alias("value"), F.col("f.valueType").alias("valueType"), F.col("f.eventTs").alias("eventTs")).alias("f"))
    doc = latest.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("e"), F.max("f.eventTs").alias("updatedTs"))
    facts_json = F.to_json(F.map_from_entries("e"))
    return doc.select(*by, F.size("e").cast("long").alias("factCount"), "updatedTs", facts_json.alias("factsJson"))


def hot_channels(control: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """channel, until: saturated channels that are closed until midnight or a time to live after the event; old and future events do not count."""
    until = F.least(next_midnight(F.col("eventTs")), F.col("eventTs") + ttl_ms)
    return control.where(F.col("eventTs") <= now_ms).groupBy("channel").agg(F.max(until).alias("until")).where(F.col("until") > now_ms)


def throttle_levels(control: DataFrame) -> DataFrame:
    """The latest level for each throttle key."""
    return control.groupBy("key").agg(F.max_by("level", F.struct("eventTs", "level")).alias("level"), F.max("eventTs").alias("eventTs"))


def drop_expired_scores(facts: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """Without scores older than the time to live (0: off); other facts, and scores without a time, never expire."""
    if not ttl_ms:
        return facts
    return facts.where(~F.col("key").startswith("nba.score.") | F.col("eventTs").isNull() | (F.col("eventTs") >= now_ms - ttl_ms))


def prune_facts(gold: DataFrame, removed: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(gold without the removed keys, the members that changed)."""
    kept = gold.join(removed.select("key").distinct(), "key", "left_anti")
    return kept, gold.join(removed.select("key").distinct(), "key", "left_semi").select(by).distinct()


def materialize_eligibility(evaluations: DataFrame, by: str, ts: str) -> DataFrame:
    """The latest evaluation for each ``by``; a null document deletes."""
    return evaluations.groupBy(by).agg(F.max_by("doc", F.col(ts)).alias("doc"), F.max(ts).alias(ts)).where("doc is not null")


def fleet_suppress(control: DataFrame, live: DataFrame) -> DataFrame:
    """SUPPRESS for each live instance that a control row newly covers: on where it was off before, on all channels or on one."""
    order = Window.partitionBy("actionId", "channel").orderBy("eventTs")
    rising = control.withColumn("_was", F.lag("on", 1, False).over(order)).where(F.col("on") & ~F.col("_was")).select(F.col("actionId").alias("c_action"), F.col("channel").alias("c_channel"), "eventTs")
    rising = rising.groupBy("c_action", "c_channel").agg(F.min("eventTs").alias("eventTs"))  # only the first counts, and few rows are left to join
    hit = live.join(rising, (F.col("actionId") == F.col("c_action")) & (F.col("c_channel").isNull() | (F.col("c_channel") == F.col("channel"))))
    return hit.groupBy("entityId", "actionId", "channel").agg(F.min("eventTs").alias("eventTs")).withColumn("op", F.lit("SUPPRESS"))


def inbound_journey(serves: DataFrame, dispositions: DataFrame, completions: DataFrame, funnel: list[str]) -> DataFrame:
    """correlationId, servedTs, status, completed: serves with their furthest valid status and whether they were completed."""
    valid = dispositions.where(F.col("status").isin(funnel)).groupBy("correlationId").agg(F.max(F.array_position(F.array(*map(F.lit, funnel)), F.col("status"))).alias("stage"))
    done = completions.select("correlationId", F.lit(True).alias("completed")).distinct()
    joined = serves.join(valid, "correlationId", "left").join(done, "correlationId", "left")
    return joined.select("correlationId", "servedTs", F.try_element_at(F.array(*map(F.lit, funnel)), F.coalesce("stage", F.lit(99)).cast("int")).alias("status"), F.coalesce("completed", F.lit(False)).alias("completed"))
