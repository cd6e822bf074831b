"""Counters, funnels, health and experiment readouts. Counters aggregate before they shuffle; ``now_ms`` is always a parameter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import DAY_MS, day_floor
from tidemark.operators.selection import group_percentiles

HOUR_MS = 3_600_000

# Lifecycle states in the order that reports use.
STATES = ("CREATED", "IN_PROCESS", "PRESENTED", "SOFT_COMPLETED", "DECLINED", "SUPPRESSING", "FAILED", "HARD_COMPLETED", "EXPIRED", "SUPPRESSED", "DEBOUNCED")


def count_where(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0))


def distinct_where(column: str, condition: Column) -> Column:
    return F.count_distinct(F.when(condition, F.col(column)))


SEND = ["entityId", "actionId", "channel", "eventTs", "value"]


def net_sends(facts: DataFrame, since: dict[str, int], until_ms: int) -> DataFrame:
    """channel and for each name of ``since`` the sends from that time to ``until_ms``, less the failed and suppressed, not below 0.

    Repeated facts count once, whatever batch they came in.
    """
    states = facts.where("factClass = 'actionstate'").where(F.col("eventTs").between(min(since.values()), until_ms)).select(SEND).distinct()

    def level(from_ms: int) -> Column:
        inside = F.col("eventTs") >= from_ms
        return F.greatest(F.lit(0).cast("long"), count_where(inside & (F.col("value") == "IN_PROCESS")) - count_where(inside & F.col("value").isin("FAILED", "SUPPRESSED")))

    return states.groupBy("channel").agg(*(level(ms).alias(name) for name, ms in since.items()))


def gross_sends(facts: DataFrame, since_ms: int) -> DataFrame:
    """channel, sends: distinct dispositions ``sent``; tuples with a null do not count."""
    sent = facts.where((F.col("factClass") == "disposition") & (F.col("value") == "sent") & (F.col("eventTs") >= since_ms))
    return sent.groupBy("channel").agg(F.count_distinct("entityId", "actionId", "channel", "eventTs").alias("sends"))


def zero_fill(df: DataFrame, dims: dict[str, list], columns: list[str]) -> DataFrame:
    """A row for each combination of the fixed ``dims``; missing ``columns`` are 0."""
    spark = df.sparkSession
    frames = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in dims.items()]
    grid = reduce(lambda a, b: a.crossJoin(b), frames)
    return F.broadcast(grid).join(df, list(dims), "left").select(*dims, *(F.coalesce(c, F.lit(0)).alias(c) for c in columns))


def comms_counts(facts: DataFrame, now_ms: int, window_ms: int, value: str) -> DataFrame:
    """entityId, key, n: a member's contacts in the window for each channel and in total, from one rollup."""
    recent = facts.where((F.col("value") == value) & (F.col("eventTs") > now_ms - window_ms) & (F.col("eventTs") <= now_ms)).select(SEND).distinct()
    counts = recent.rollup("entityId", "channel").agg(F.count(F.lit(1)).alias("n"), F.grouping("channel").alias("all")).where("entityId is not null")
    key = F.when(F.col("all") == 1, F.lit("operator.comms.totalThisWeek")).otherwise(F.concat(F.lit("operator.comms."), "channel", F.lit("sThisWeek")))
    return counts.select("entityId", key.alias("key"), "n")


def system_stats(members: DataFrame, candidates: DataFrame, sends: DataFrame) -> DataFrame:
    """One row: members, eligible, scored, activated, sent (distinct members of each step)."""
    def distinct(df: DataFrame, name: str, condition: Column | None = None) -> DataFrame:
        return (df if condition is None else df.where(condition)).agg(F.count_distinct("entityId").alias(name))

    eligible = candidates.agg(distinct_where("entityId", F.col("eligible")).alias("eligible"), distinct_where("entityId", F.col("eligible") & F.col("score").isNotNull()).alias("scored"), distinct_where("entityId", F.col("active")).alias("activated"))
    return distinct(members, "members").crossJoin(eligible).crossJoin(distinct(sends, "sent"))


def action_stats(routed: DataFrame) -> DataFrame:
    """actionId, created, suppressed (distinct members of each decision) and avgScore of the decisions, to 3 places; null where none has a score."""
    distinct = [distinct_where("entityId", F.col("op") == op).alias(name) for op, name in (("CREATE", "created"), ("SUPPRESS", "suppressed"))]
    return routed.groupBy("actionId").agg(*distinct, F.round(F.avg("score"), 3).alias("avgScore"))


def fact_library(facts: DataFrame, samples: int = 8) -> DataFrame:
    """key, types, cardinality, n and the first sorted sample values of each fact that is not internal.

    Values are counted first; of a key's distinct values only the first ``samples`` pass the ranking, which Spark cuts off before it shuffles.
    """
    own = facts.where(~F.col("key").startswith("nba."))
    per_value = own.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.min("valueType").alias("valueType"))
    ranked = per_value.groupBy("key").agg(F.min("valueType").alias("valueType"), F.count("value").alias("cardinality"), F.sum("n").alias("n"))
    from pyspark.sql import Window

    first = per_value.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("value"))).where(F.col("place") <= samples)
    picked = first.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("samples"))
    return ranked.join(picked, "key")


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """bucket (0 for below the first edge), n."""
    bucket = reduce(lambda c, e: c + (F.col(column) >= e).cast("int"), edges, F.lit(0))
    return df.where(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def disposition_funnels(dispositions: DataFrame, funnels: dict[str, list[str]]) -> DataFrame:
    """channel, stage, status, members: the declared stages in order, zero-filled, then any other status after them."""
    spark = dispositions.sparkSession
    declared = spark.createDataFrame([(c, i, s) for c, stages in funnels.items() for i, s in enumerate(stages)], "channel string, stage int, status string")
    seen = dispositions.groupBy("channel", F.col("raw").alias("status")).agg(F.count_distinct("entityId").alias("members"))
    both = seen.join(F.broadcast(declared), ["channel", "status"], "full")
    return both.select("channel", F.coalesce("stage", F.lit(99)).alias("stage"), "status", F.coalesce("members", F.lit(0)).alias("members"))


def variant_performance(dispositions: DataFrame, sent: DataFrame, stages: list[str]) -> DataFrame:
    """actionId, contentKey, sent, deepest, conversion, winner: conversion is the members at the deepest reached stage over
    those sent; the winner of an action has the best one, then the most sends. Actions with one variant are left out."""
    from pyspark.sql import Window

    reached = dispositions.groupBy("actionId", "contentKey").agg(*(distinct_where("entityId", F.col("raw") == s).alias(f"at_{i}") for i, s in enumerate(stages)))
    both = sent.groupBy("actionId", "contentKey").agg(F.count_distinct("entityId").alias("sent")).join(reached, ["actionId", "contentKey"], "left")
    deepest = F.coalesce(*[F.when(F.col(f"at_{i}") > 0, F.lit(i)) for i in reversed(range(len(stages)))])
    at = F.coalesce(*[F.when(F.col(f"at_{i}") > 0, F.col(f"at_{i}")) for i in reversed(range(len(stages)))], F.lit(0))
    scored = both.select("actionId", "contentKey", "sent", deepest.alias("deepest"), (at / F.col("sent")).alias("conversion"))
    own = Window.partitionBy("actionId")
    ranked = scored.withColumn("variants", F.count(F.lit(1)).over(own)).where("variants > 1")
    best = F.row_number().over(own.orderBy(F.desc("conversion"), F.desc("sent"), "contentKey"))
    return ranked.withColumn("winner", best == 1).drop("variants")


def hourly_series(sends: DataFrame, ts: str, day_ms: int) -> DataFrame:
    """channel, hour (0 to 23), n on one UTC day, zero-filled for channels that have any send at all."""
    counts = sends.where(day_floor(F.col(ts)) == day_ms).groupBy("channel", F.floor(F.pmod(F.col(ts), F.lit(DAY_MS)) / HOUR_MS).cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    grid = sends.select("channel").distinct().select("channel", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return grid.join(counts, ["channel", "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def throttle_stats(levels: DataFrame, caps: dict[str, int]) -> DataFrame:
    """channel, level, cap, utilisation, throttled."""
    cap = F.coalesce(F.lit(None).cast("int"), *[F.when(F.col("channel") == c, F.lit(n)) for c, n in caps.items()])
    return levels.select("channel", "level", cap.alias("cap"), F.round(F.col("level") / cap, 4).alias("utilisation"), F.coalesce(F.col("level") >= cap, F.lit(False)).alias("throttled"))


def layer_health(df: DataFrame, layer: str, ts: str, now_ms: int) -> DataFrame:
    """One row: lastHour, previousHour, lastTs, baseline (mean of this hour of day over the 7 days before), status; one pass."""
    at, day = F.col(ts), F.col(ts).between(now_ms - 7 * DAY_MS - HOUR_MS, now_ms)
    last = (at > now_ms - HOUR_MS) & (at <= now_ms)
    before = (at > now_ms - 2 * HOUR_MS) & (at <= now_ms - HOUR_MS)
    ago = F.lit(now_ms) - at
    same_hour = day & (ago >= DAY_MS) & (F.pmod(ago, F.lit(DAY_MS)) < HOUR_MS) & (ago < 8 * DAY_MS)
    row = df.where(at <= now_ms).agg(count_where(last).alias("lastHour"), count_where(before).alias("previousHour"), F.max(at).alias("lastTs"), (count_where(same_hour) / F.lit(7)).alias("baseline"))
    status = F.when((F.col("baseline") >= 3) & (F.col("lastHour") < 0.25 * F.col("baseline")), "degraded").when((F.col("baseline") < 1) & (F.col("lastHour") == 0), "quiet").otherwise("ok")
    return row.select(F.lit(layer).alias("layer"), "*", status.alias("status"))


def check(name: str, group: str, bad: DataFrame) -> DataFrame:
    """One row (name, group, ok, detail): ok where ``bad`` has no row."""
    return bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(group).alias("group"), (F.col("n") == 0).alias("ok"), F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"))


def system_checks(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def recent_traces(routed: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` correlations: lastTs, winner (created action), suppressed (distinct actions). Sorted top-n, no full sort."""
    grouped = routed.groupBy("correlationId").agg(F.max("ts").alias("lastTs"), F.max(F.when(F.col("op") == "CREATE", F.col("actionId"))).alias("winner"), distinct_where("actionId", F.col("op") == "SUPPRESS").alias("suppressed"))
    return grouped.orderBy(F.desc("lastTs"), F.desc("correlationId")).limit(n)


def sample_members(touches: DataFrame, done: DataFrame, n: int) -> DataFrame:
    """The ``n`` members that came furthest: milestones, then distinct actions, then recency."""
    journey = touches.groupBy("entityId").agg(F.count_distinct("actionId").alias("actions"), F.max("ts").alias("lastTs"))
    reached = done.groupBy("entityId").agg(F.count_distinct("actionId").alias("milestones"))
    both = journey.join(reached, "entityId", "left").withColumn("milestones", F.coalesce("milestones", F.lit(0)))
    return both.orderBy(F.desc("milestones"), F.desc("actions"), F.desc("lastTs"), "entityId").limit(n)


def state_rollup(latest: DataFrame, states: tuple[str, ...] = STATES) -> DataFrame:
    """state, n over current states, all canonical ones, zero-filled, others left out."""
    counts = latest.groupBy(F.col("value").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return zero_fill(counts, {"state": list(states)}, ["n"])


def lake_status(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n, members."""
    rows = [df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entityId").alias("members")).select(F.lit(name).alias("table"), "n", "members") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def warm_lift(states: DataFrame) -> DataFrame:
    """channel, P(hard | soft), P(hard | not soft) and their difference over (member, channel)."""
    flags = states.groupBy("entityId", "channel").agg(F.max((F.col("state") == "PRESENTED").cast("int")).alias("soft"), F.max((F.col("state") == "HARD_COMPLETED").cast("int")).alias("hard"))
    rates = flags.groupBy("channel").agg(F.avg(F.when(F.col("soft") == 1, F.col("hard"))).alias("warm"), F.avg(F.when(F.col("soft") == 0, F.col("hard"))).alias("cold"))
    return rates.withColumn("lift", F.col("warm") - F.col("cold"))


def normal_tail(z: Column) -> Column:
    """Two-sided p-value of a standard normal, by the Abramowitz and Stegun approximation 7.1.26 of erfc (error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def ab_readout(members: DataFrame, arm: Column, reached: Column) -> DataFrame:
    """One row: sizes, rates, lift, z and p of treatment (arm true) against control."""
    sums = members.agg(count_where(arm).alias("n_t"), count_where(~arm).alias("n_c"), count_where(arm & reached).alias("x_t"), count_where(~arm & reached).alias("x_c"))
    rate_t, rate_c = F.col("x_t") / F.col("n_t"), F.col("x_c") / F.col("n_c")
    pooled = (F.col("x_t") + F.col("x_c")) / (F.col("n_t") + F.col("n_c"))
    z = (rate_t - rate_c) / F.sqrt(pooled * (1 - pooled) * (1 / F.col("n_t") + 1 / F.col("n_c")))
    out = sums.select("n_t", "n_c", rate_t.alias("rate_t"), rate_c.alias("rate_c"), (rate_t - rate_c).alias("lift"), z.alias("z"))
    return out.withColumn("p", normal_tail(F.col("z"))).withColumn("significant", F.col("p") < 0.05)


def dlq_stats(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy("consumer").agg(F.count(F.lit(1)).alias("depth"), F.max_by("error", F.struct("dlqTs", "partition", "offset")).alias("lastError"))


def stage_metrics(hops: DataFrame, ts: str, width_ms: int, quorum: int = 3) -> DataFrame:
    """windowStart, events, perSecond, p50, avg, p95 of latency, null below the quorum."""
    start = (F.col(ts) - F.pmod(F.col(ts), F.lit(width_ms))).alias("windowStart")
    grouped = group_percentiles(hops, [start], "latency", {"p50": 0.5, "p95": 0.95}).withColumnRenamed("n", "events")
    enough = F.col("events") >= quorum
    return grouped.select("windowStart", "events", (F.col("events") * 1000 / width_ms).alias("perSecond"), *(F.when(enough, F.col(c)).alias(c) for c in ("p50", "mean", "p95")))


def freshness(df: DataFrame, ts: str, now_ms: int, bar_ms: int) -> DataFrame:
    return df.agg(F.max(ts).alias("lastTs")).select("lastTs", (F.lit(now_ms) - F.col("lastTs")).alias("age"), (F.lit(now_ms) - F.col("lastTs") <= bar_ms).alias("fresh"))


def reconcile_facts(used: DataFrame, known: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(added, removed, backfill): fact keys newly referenced or no longer, and the members' facts of the added keys."""
    added, removed = used.subtract(known), known.subtract(used)
    return added, removed, gold.join(added, "key", "left_semi")


def member_document(facts: DataFrame, events: list[tuple[str, DataFrame]]) -> DataFrame:
    """entityId, facts (map) and timeline (array of ts, kind, actionId, channel, detail in order) for each member."""
    from tidemark.operators.ingest import member_fact_map

    every = reduce(DataFrame.unionByName, [df.select("entityId", F.struct("ts", F.lit(kind).alias("kind"), "actionId", "channel", "detail").alias("e")) for kind, df in events])
    timeline = every.groupBy("entityId").agg(F.array_sort(F.collect_list("e")).alias("timeline"))
    return member_fact_map(facts).join(timeline, "entityId", "left")


def live_feed(feeds: list[DataFrame], n: int) -> DataFrame:
    """The newest ``n`` (1 to 200) events over all feeds (kind, ts, entityId, detail)."""
    every = reduce(DataFrame.unionByName, feeds)
    return every.orderBy(F.desc("ts"), "kind", "entityId", "detail").limit(max(1, min(200, n)))


def emitter_of(topic: Column, source: Column, kind: Column) -> Column:
    """The component that emitted an event."""
    by_topic = {"datalake.streaming-inbound": "source", "nba.facts": "lake", "nba.snapshots": "snapshot", "nba.evaluations": "rules", "nba.activations": "temporal", "nba.definitions": "source"}
    by_source = {"ml": "ml", "temporal": "temporal", "action-layer": "action", "action-router": "router", "rules-engine": "rules", "rules": "rules"}
    found = F.when(kind == "router", "router")
    for value, name in by_topic.items():
        found = found.when(topic == value, name)
    for value, name in by_source.items():
        found = found.when(F.lower(source) == value, name)
    return found.when(topic == "nba.member.facts", "lake").otherwise("source")


