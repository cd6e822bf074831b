"""The decision engine's tables, derived from the star schema and the event stream.

Each function takes (spark, sf_dir). ``SQL`` has the same tables as common table expressions for other SQL engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import stable01

#: The moment that reports are made for: 2024-01-31, the day after the event stream ends.
NOW_MS = 1_706_659_200_000
PROFILE_MS = 1_704_067_200_000
HOUR_MS, DAY_MS = 3_600_000, 86_400_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    return F.unix_millis(F.to_timestamp(ts))


def entity(key: Column) -> Column:
    return F.concat(F.lit("op-"), key.cast("string"))


def action(key: Column) -> Column:
    return F.concat(F.lit("action_"), (key % 15).cast("string"))


FACT_COLUMNS = ["entityType", "entityId", "key", "value", "valueType", "eventTs", "source"]


def _fact(entity_id: Column, key: Column, value: Column, kind: Column, ts: Column, source: str) -> list[Column]:
    columns = [F.lit("OPERATOR"), entity_id, key, value, kind, ts, F.lit(source)]
    return [c.alias(n) for c, n in zip(columns, FACT_COLUMNS, strict=True)]


def facts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One activity fact for each event."""
    e = read(spark, sf_dir, "events")
    return e.select(_fact(entity(F.col("user_id")), F.concat(F.lit("operator.activity."), "event_type"), F.col("value").cast("string"), F.lit("DOUBLE"), millis(F.col("ts")), "events"))


def facts_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four profile facts for each customer."""
    key = F.col("c_custkey")
    values = [
        ("isDNC", (key % 33 == 0).cast("string"), "BOOLEAN"),
        ("smsConsent", (key % 7 != 0).cast("string"), "BOOLEAN"),
        ("balance", F.col("c_acctbal").cast("string"), "DOUBLE"),
        ("segment", F.col("c_mktsegment"), "STRING"),
    ]
    made = F.array(*[F.struct(F.lit(f"operator.profile.{n}").alias("key"), v.alias("value"), F.lit(t).alias("valueType")) for n, v, t in values])
    c = read(spark, sf_dir, "customer").select(key, F.explode(made).alias("f"))
    return c.select(_fact(entity(key), F.col("f.key"), F.col("f.value"), F.col("f.valueType"), F.lit(PROFILE_MS), "crm"))


# Which channel an order of a priority, or an event of a type, goes by.
PRIORITY_CHANNEL = {"1": "voice", "2": "sms", "3": "email", "4": "mail"}
EVENT_CHANNEL = {"click": "email", "view": "push", "signup": "sms", "purchase": "voice", "error": "mail"}


def _by(value: Column, channels: dict[str, str], other: str | None = None) -> Column:
    found = F.coalesce(*[F.when(value == k, F.lit(v)) for k, v in channels.items()])
    return found if other is None else F.coalesce(found, F.lit(other))


def sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entityId, actionId, channel, decisionTs, correlationId, status: one contact for each order."""
    o = read(spark, sf_dir, "orders")
    channel = _by(F.substring("o_orderpriority", 1, 1), PRIORITY_CHANNEL, "push")
    return o.select(
        entity(F.col("o_custkey")).alias("entityId"), action(F.col("o_orderkey")).alias("actionId"), channel.alias("channel"),
        millis(F.col("o_orderdate")).alias("decisionTs"), F.concat(F.lit("c-"), F.col("o_orderkey").cast("string")).alias("correlationId"), F.col("o_orderstatus").alias("status"),
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entityId, actionId, channel, state, stTs, correlationId: the lifecycle of each contact."""
    s = sends(spark, sf_dir)
    at, status = F.col("decisionTs"), F.col("status")
    steps = F.array(
        F.struct(F.lit("IN_PROCESS").alias("state"), at.alias("stTs")),
        F.when(status.isin("F", "O"), F.struct(F.lit("PRESENTED").alias("state"), (at + HOUR_MS).alias("stTs"))),
        F.when(status == "F", F.struct(F.lit("HARD_COMPLETED").alias("state"), (at + DAY_MS).alias("stTs"))),
        F.when(status == "P", F.struct(F.lit("FAILED").alias("state"), (at + HOUR_MS).alias("stTs"))),
    )
    return s.select("*", F.explode(F.array_compact(steps)).alias("s")).select("entityId", "actionId", "channel", "s.state", "s.stTs", "correlationId")


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entityId, actionId, channel, raw, eventTs, correlationId: provider statuses, one for each line item of a contact."""
    li = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("c-"), F.col("l_orderkey").cast("string")).alias("correlationId"), _by(F.col("l_returnflag"), {"N": "Delivered", "A": "Opened", "R": "Unsubscribe"}).alias("raw"), millis(F.col("l_shipdate")).alias("eventTs"))
    return li.join(sends(spark, sf_dir), "correlationId").select("entityId", "actionId", "channel", "raw", "eventTs", "correlationId")


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entityId, actionId, channel, ts, touchId: a dense contact history, one touch for each event."""
    e = read(spark, sf_dir, "events")
    return e.select(entity(F.col("user_id")).alias("entityId"), action(F.col("event_id")).alias("actionId"), _by(F.col("event_type"), EVENT_CHANNEL).alias("channel"), millis(F.col("ts")).alias("ts"), F.col("event_id").alias("touchId"))


def fact_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts: activity, profile, and of the contact history states (IN_PROCESS, some FAILED) and external sends."""
    t = touches(spark, sf_dir)
    state = F.when(F.col("touchId") % 10 == 3, "FAILED").otherwise("IN_PROCESS")
    sent = t.where("touchId % 4 <> 0").select(_fact(F.col("entityId"), F.concat_ws(".", F.lit("nba.actionstate"), "actionId", "channel"), state, F.lit("STRING"), F.col("ts"), "temporal"))
    external = t.where("touchId % 4 = 0").select(_fact(F.col("entityId"), F.concat(F.lit("comms.sent."), "channel"), F.lit("1"), F.lit("LONG"), F.col("ts"), "vendor"))
    raw = F.when(F.col("touchId") % 3 == 0, "Opened").when(F.col("touchId") % 11 == 1, "Unsubscribe").otherwise("Delivered")
    responded = t.where("touchId % 5 = 1").select(_fact(F.col("entityId"), F.concat_ws(".", F.lit("nba.disposition"), "actionId", "channel"), raw, F.lit("STRING"), F.col("ts") + HOUR_MS, "action-layer"))
    scored = t.where("touchId % 6 = 2").select(_fact(F.col("entityId"), F.concat_ws(".", F.lit("nba.score"), "actionId", "channel"), F.round(stable01(F.col("entityId"), F.col("actionId"), F.col("channel")), 4).cast("decimal(5,4)").cast("string"), F.lit("DOUBLE"), F.col("ts") + 1000, "ml"))
    return facts_events(spark, sf_dir).unionByName(facts_profile(spark, sf_dir)).unionByName(sent).unionByName(external).unionByName(responded).unionByName(scored)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (action, channel) that a member was evaluated for on a day, with a score and a lifecycle state.

    entityId, evaluatedAt, correlationId, actionId, channel, score, workflowState, active, cancellable, softCompleted,
    hardCompleted, eligible, contentKey. Members on the do-not-contact list are never eligible, sms needs consent.
    """
    t = touches(spark, sf_dir)
    day = F.floor(F.col("ts") / DAY_MS) * DAY_MS
    c = t.select("entityId", day.cast("long").alias("evaluatedAt"), "actionId", "channel").distinct()
    key = F.substring("entityId", 4, 20).cast("long")
    u = stable01(F.lit("state"), F.col("entityId"), F.col("evaluatedAt").cast("string"), F.col("actionId"), F.col("channel"))
    c = c.withColumn("score", stable01(F.col("entityId"), F.col("actionId"), F.col("channel"))).withColumn("u", u)
    state = F.when(F.col("u") < 0.1, "CREATED").when(F.col("u") < 0.15, "IN_PROCESS").when(F.col("u") < 0.2, "PRESENTED").when(F.col("u") < 0.25, "DECLINED").when(F.col("u") < 0.3, "EXPIRED")
    c = c.withColumn("workflowState", state).withColumn("active", F.coalesce(F.col("workflowState") != "EXPIRED", F.lit(False)))
    eligible = (key % 33 != 0) & ((F.col("channel") != "sms") | (key % 7 != 0)) & (F.col("u") <= 0.97)
    return c.select(
        "entityId", "evaluatedAt", F.concat_ws("-", "entityId", F.col("evaluatedAt").cast("string")).alias("correlationId"), "actionId", "channel",
        F.when(F.col("u") < 0.95, F.col("score")).alias("score"), "workflowState", "active", F.coalesce(F.col("workflowState") == "CREATED", F.lit(False)).alias("cancellable"),
        ((F.col("u") > 0.17) & (F.col("u") < 0.22)).alias("softCompleted"), (F.col("u") > 0.93).alias("hardCompleted"), eligible.alias("eligible"), F.concat(F.lit("tmpl."), "actionId").alias("contentKey"),
    )


def _stable01_sql(*parts: str) -> str:
    return f"(('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 8))::BIGINT / 4294967295::DOUBLE)"


SQL = {
    "facts_events": "SELECT 'OPERATOR' AS \"entityType\", 'op-' || user_id AS \"entityId\", 'operator.activity.' || event_type AS key, value::VARCHAR AS value, 'DOUBLE' AS \"valueType\", epoch_us(ts) // 1000 AS \"eventTs\", 'events' AS source FROM events",
    "facts_profile": f"""SELECT 'OPERATOR' AS "entityType", 'op-' || c_custkey AS "entityId", 'operator.profile.' || f.k AS key, f.v AS value, f.t AS "valueType", {PROFILE_MS}::BIGINT AS "eventTs", 'crm' AS source
        FROM (SELECT c_custkey, unnest([{{'k': 'isDNC', 'v': (c_custkey % 33 = 0)::VARCHAR, 't': 'BOOLEAN'}}, {{'k': 'smsConsent', 'v': (c_custkey % 7 <> 0)::VARCHAR, 't': 'BOOLEAN'}},
            {{'k': 'balance', 'v': c_acctbal::VARCHAR, 't': 'DOUBLE'}}, {{'k': 'segment', 'v': c_mktsegment, 't': 'STRING'}}]) AS f FROM customer)""",
    "sends": """SELECT 'op-' || o_custkey AS "entityId", 'action_' || (o_orderkey % 15) AS "actionId", CASE o_orderpriority[1] WHEN '1' THEN 'voice' WHEN '2' THEN 'sms' WHEN '3' THEN 'email' WHEN '4' THEN 'mail' ELSE 'push' END AS channel,
        epoch_us(o_orderdate) // 1000 AS "decisionTs", 'c-' || o_orderkey AS "correlationId", o_orderstatus AS status FROM orders""",
    "states": f"""SELECT "entityId", "actionId", channel, 'IN_PROCESS' AS state, "decisionTs" AS "stTs", "correlationId" FROM sends
        UNION ALL SELECT "entityId", "actionId", channel, 'PRESENTED', "decisionTs" + {HOUR_MS}, "correlationId" FROM sends WHERE status IN ('F', 'O')
        UNION ALL SELECT "entityId", "actionId", channel, 'HARD_COMPLETED', "decisionTs" + {DAY_MS}, "correlationId" FROM sends WHERE status = 'F'
        UNION ALL SELECT "entityId", "actionId", channel, 'FAILED', "decisionTs" + {HOUR_MS}, "correlationId" FROM sends WHERE status = 'P'""",
    "dispositions": """SELECT s."entityId", s."actionId", s.channel, CASE l_returnflag WHEN 'N' THEN 'Delivered' WHEN 'A' THEN 'Opened' WHEN 'R' THEN 'Unsubscribe' END AS raw, epoch_us(l_shipdate) // 1000 AS "eventTs", s."correlationId"
        FROM lineitem JOIN sends s ON s."correlationId" = 'c-' || l_orderkey""",
    "touches": """SELECT 'op-' || user_id AS "entityId", 'action_' || (event_id % 15) AS "actionId", CASE event_type WHEN 'click' THEN 'email' WHEN 'view' THEN 'push' WHEN 'signup' THEN 'sms' WHEN 'purchase' THEN 'voice' WHEN 'error' THEN 'mail' END AS channel,
        epoch_us(ts) // 1000 AS ts, event_id AS "touchId" FROM events""",
    "fact_history": f"""SELECT * FROM facts_events UNION ALL SELECT * FROM facts_profile
        UNION ALL SELECT 'OPERATOR', "entityId", 'nba.actionstate.' || "actionId" || '.' || channel, CASE WHEN "touchId" % 10 = 3 THEN 'FAILED' ELSE 'IN_PROCESS' END, 'STRING', ts, 'temporal' FROM touches WHERE "touchId" % 4 <> 0
        UNION ALL SELECT 'OPERATOR', "entityId", 'comms.sent.' || channel, '1', 'LONG', ts, 'vendor' FROM touches WHERE "touchId" % 4 = 0
        UNION ALL SELECT 'OPERATOR', "entityId", 'nba.disposition.' || "actionId" || '.' || channel, CASE WHEN "touchId" % 3 = 0 THEN 'Opened' WHEN "touchId" % 11 = 1 THEN 'Unsubscribe' ELSE 'Delivered' END, 'STRING', ts + {HOUR_MS}, 'action-layer' FROM touches WHERE "touchId" % 5 = 1
        UNION ALL SELECT 'OPERATOR', "entityId", 'nba.score.' || "actionId" || '.' || channel, round({_stable01_sql('"entityId"', '"actionId"', 'channel')}, 4)::DECIMAL(5,4)::VARCHAR, 'DOUBLE', ts + 1000, 'ml' FROM touches WHERE "touchId" % 6 = 2""",
    "candidates": f"""SELECT "entityId", "evaluatedAt", "entityId" || '-' || "evaluatedAt" AS "correlationId", "actionId", channel, CASE WHEN u < 0.95 THEN sc END AS score, "workflowState",
            coalesce("workflowState" <> 'EXPIRED', false) AS active, coalesce("workflowState" = 'CREATED', false) AS cancellable, u > 0.17 AND u < 0.22 AS "softCompleted", u > 0.93 AS "hardCompleted",
            (k % 33 <> 0) AND (channel <> 'sms' OR k % 7 <> 0) AND u <= 0.97 AS eligible, 'tmpl.' || "actionId" AS "contentKey"
        FROM (SELECT *, substr("entityId", 4)::BIGINT AS k, CASE WHEN u < 0.1 THEN 'CREATED' WHEN u < 0.15 THEN 'IN_PROCESS' WHEN u < 0.2 THEN 'PRESENTED' WHEN u < 0.25 THEN 'DECLINED' WHEN u < 0.3 THEN 'EXPIRED' END AS "workflowState"
            FROM (SELECT *, {_stable01_sql('"entityId"', '"actionId"', 'channel')} AS sc, {_stable01_sql("'state'", '"entityId"', '"evaluatedAt"', '"actionId"', 'channel')} AS u
                FROM (SELECT DISTINCT "entityId", ts // {DAY_MS} * {DAY_MS} AS "evaluatedAt", "actionId", channel FROM touches)))""",
}

#: Tables that each of the above is made from.
NEEDS = {"states": ["sends"], "dispositions": ["sends"], "fact_history": ["facts_events", "facts_profile", "touches"], "candidates": ["touches"]}


def oracle(tables: str, select: str) -> str:
    """SQL that defines the named tables (and what they need) before ``select``, which may go on with further ``name AS (...)``."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in tables.split():
        add(name)
    made = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    return f"WITH {made}{', ' if select.lstrip()[:6].upper() != 'SELECT' else ' '}{select.strip()}"
