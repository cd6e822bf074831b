"""Queries: ordered work inside a key, and batch twins of the stateful streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import learning, sequences
from tidemark.operators.merging import latest_per_key
from tidemark.plans.register import Register
from tidemark.sources import tables as T

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql

NOW, DAY = T.NOW_MS, T.DAY_MS


@query(T.oracle("fact_history", "SELECT entityId, key, max(eventTs) AS eventTs, arg_max(value, (eventTs, value)) AS value FROM fact_history GROUP BY entityId, key"))
def w1_w5_latest_fact(spark, sf_dir):
    f = T.fact_history(spark, sf_dir).select("entityId", "key", "value", "eventTs")
    return latest_per_key(f, ["entityId", "key"], "eventTs", ["value"])


@query(T.oracle("candidates", "SELECT entityId, max(evaluatedAt) AS evaluatedAt, arg_max(n, evaluatedAt) AS n FROM (SELECT entityId, evaluatedAt, count(*) AS n FROM candidates GROUP BY ALL) GROUP BY entityId"))
def w6_latest_evaluation(spark, sf_dir):
    e = T.candidates(spark, sf_dir).groupBy("entityId", "evaluatedAt").agg(F.count(F.lit(1)).alias("n"))
    return latest_per_key(e, ["entityId"], "evaluatedAt", ["n"])


@query(T.oracle("touches", f"""SELECT touchId, count(*) OVER (PARTITION BY entityId, channel ORDER BY ts RANGE BETWEEN {14 * DAY} PRECEDING AND 1 PRECEDING) AS thisChannelRecentN,
    count(*) OVER (PARTITION BY entityId, actionId ORDER BY ts RANGE BETWEEN {14 * DAY} PRECEDING AND 1 PRECEDING) AS thisActionRecentN,
    coalesce((ts - max(ts) OVER (PARTITION BY entityId ORDER BY ts RANGE BETWEEN {14 * DAY} PRECEDING AND 1 PRECEDING)) / {DAY}, 14.0) AS daysSinceLastContact FROM touches"""))
def w3_w4_contact_context(spark, sf_dir):
    t = sequences.trailing_counts(T.touches(spark, sf_dir), "ts", 14, {"thisChannelRecentN": ["entityId", "channel"], "thisActionRecentN": ["entityId", "actionId"]})
    return sequences.days_since_contact(t, ["entityId"], "ts", 14, 14.0).select("touchId", "thisChannelRecentN", "thisActionRecentN", "daysSinceLastContact")


@query(T.oracle("touches", """n AS (SELECT *, row_number() OVER (PARTITION BY entityId, channel ORDER BY ts, touchId) AS touch FROM touches)
    SELECT touchId, touch, CASE channel WHEN 'email' THEN ['t0', 't1', 't2'][least(touch, 3)] WHEN 'push' THEN 't0' ELSE 'base' END AS template FROM n"""))
def w10_t7_touch_template(spark, sf_dir):
    keys = F.when(F.col("channel") == "email", F.array(*map(F.lit, ("t0", "t1", "t2")))).when(F.col("channel") == "push", F.array(F.lit("t0")))
    return sequences.touch_template(T.touches(spark, sf_dir), ["entityId", "channel"], "ts", keys, F.lit("base"), ["touchId"]).select("touchId", "touch", "template")


SIBLING_VERDICTS = T.oracle("candidates", """c AS (SELECT *, actionId || '::' || channel AS slug, bool_or(coalesce(workflowState IN ('PRESENTED', 'DECLINED'), false)) OVER w AS settled, bool_or(coalesce(workflowState IN ('IN_PROCESS', 'SUPPRESSING'), false)) OVER w AS busy FROM candidates WINDOW w AS (PARTITION BY entityId, evaluatedAt)),
    b AS (SELECT entityId, evaluatedAt, arg_min(slug, (-coalesce(score, '-infinity'::DOUBLE), slug)) AS best FROM c WHERE workflowState = 'CREATED' GROUP BY ALL)
    SELECT c.entityId, c.evaluatedAt, actionId, channel, CASE WHEN settled OR best <> slug THEN 'LOSE' WHEN busy THEN 'WAIT' ELSE 'SEND' END AS verdict FROM c JOIN b ON b.entityId = c.entityId AND b.evaluatedAt = c.evaluatedAt WHERE workflowState = 'CREATED'""")


@query(SIBLING_VERDICTS)
def w13_j21_t8_debounce(spark, sf_dir):
    c = T.candidates(spark, sf_dir).withColumnRenamed("workflowState", "state")
    return sequences.debounce_verdict(c, ["entityId", "evaluatedAt"]).where("verdict is not null").select("entityId", "evaluatedAt", "actionId", "channel", "verdict")


@query(T.oracle("touches", f"""n AS (SELECT *, row_number() OVER (PARTITION BY channel, ts // {DAY} ORDER BY ts, touchId) AS place FROM touches)
    SELECT touchId, CASE channel WHEN 'email' THEN CASE WHEN place <= 5 THEN 'SEND' ELSE 'HOLD' END WHEN 'sms' THEN CASE WHEN place <= 2 THEN 'SEND' ELSE 'HOLD' END ELSE 'SEND' END AS decision FROM n"""))
def w15_t6_admit_batch(spark, sf_dir):
    return sequences.admit_batch(T.touches(spark, sf_dir), {"email": 5, "sms": 2}, DAY, "ts", ["touchId"]).select("touchId", "decision")


@query(T.oracle("touches", f"""n AS (SELECT *, coalesce((ts - lag(ts) OVER w >= {2 * DAY}), true)::INT AS fresh FROM touches WINDOW w AS (PARTITION BY entityId, channel ORDER BY ts, touchId)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY entityId, channel ORDER BY ts, touchId) AS run FROM n)
    SELECT entityId, channel, min(ts) AS firstTs, max(ts) AS lastTs, count(*) AS batches, arg_max(touchId, (ts, touchId)) AS touchId FROM r GROUP BY entityId, channel, run"""))
def t22_settle_batches(spark, sf_dir):
    return sequences.settle_batches(T.touches(spark, sf_dir).select("entityId", "channel", "ts", "touchId"), ["entityId", "channel"], "ts", 2 * DAY, "touchId")


@query(T.oracle("dispositions sends", """r AS (SELECT entityId, actionId, channel, max(correlationId) AS live FROM sends GROUP BY ALL)
    SELECT d.correlationId, d.raw, count(*) AS n FROM dispositions d JOIN r ON d.entityId = r.entityId AND d.actionId = r.actionId AND d.channel = r.channel AND d.correlationId = r.live GROUP BY ALL"""))
def t23_drop_stale(spark, sf_dir):
    by = ["entityId", "actionId", "channel"]
    runs = T.sends(spark, sf_dir).groupBy(*by).agg(F.max("correlationId").alias("correlationId"))
    return sequences.drop_stale(T.dispositions(spark, sf_dir), runs, by).groupBy("correlationId", "raw").agg(F.count(F.lit(1)).alias("n"))


@query(T.oracle("facts_profile", """SELECT entityId, count(*) AS factCount, max(eventTs) AS updatedTs, '{' || string_agg('"' || key || '":{"value":"' || value || '","valueType":"' || valueType || '","eventTs":' || eventTs || '}', ',' ORDER BY key) || '}' AS factsJson FROM facts_profile GROUP BY entityId"""))
def t1_fold_snapshots(spark, sf_dir):
    return sequences.fold_snapshots(T.facts_profile(spark, sf_dir), ["entityId"])


NOON = NOW - 2 * DAY + 12 * T.HOUR_MS


@query(T.oracle("touches", f"SELECT channel, max(least(ts // {DAY} * {DAY} + {DAY}, ts + 21600000)) AS until FROM touches WHERE ts <= {NOON} AND actionId < 'action_3' GROUP BY channel HAVING max(least(ts // {DAY} * {DAY} + {DAY}, ts + 21600000)) > {NOON}"))
def t12_hot_channels(spark, sf_dir):
    return sequences.hot_channels(T.touches(spark, sf_dir).where("actionId < 'action_3'").withColumnRenamed("ts", "eventTs"), NOON, 6 * T.HOUR_MS)


@query(T.oracle("touches", "SELECT 'nba.throttle.' || channel || '.rate' AS key, arg_max(touchId % 100, (ts, touchId % 100)) AS level, max(ts) AS eventTs FROM touches GROUP BY channel"))
def t11_throttle_levels(spark, sf_dir):
    t = T.touches(spark, sf_dir).select(F.concat(F.lit("nba.throttle."), "channel", F.lit(".rate")).alias("key"), (F.col("touchId") % 100).alias("level"), F.col("ts").alias("eventTs"))
    return sequences.throttle_levels(t)


@query(T.oracle("fact_history", f"SELECT key, count(*) AS n FROM fact_history WHERE NOT (key LIKE 'nba.score.%' AND eventTs < {NOW - 5 * DAY}) GROUP BY key"))
def t13_drop_expired_scores(spark, sf_dir):
    return sequences.drop_expired_scores(T.fact_history(spark, sf_dir), NOW, 5 * DAY).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(T.oracle("fact_history", "SELECT entityId, count(*) AS kept, bool_or(key = 'operator.activity.view') AS changed, count(*) - count_if(key = 'operator.activity.view') AS n FROM fact_history GROUP BY entityId"))
def t14_prune_facts(spark, sf_dir):
    f = T.fact_history(spark, sf_dir)
    kept, changed = sequences.prune_facts(f, f.where("key = 'operator.activity.view'"), "entityId")
    counts = f.groupBy("entityId").agg(F.count(F.lit(1)).alias("kept")).join(kept.groupBy("entityId").agg(F.count(F.lit(1)).alias("n")), "entityId", "left")
    return counts.join(changed.withColumn("changed", F.lit(True)), "entityId", "left").select("entityId", "kept", F.coalesce("changed", F.lit(False)).alias("changed"), F.coalesce("n", F.lit(0)).alias("n"))


@query(T.oracle("candidates", "SELECT entityId, evaluatedAt, doc FROM (SELECT entityId, max(evaluatedAt) AS evaluatedAt, arg_max_null(doc, evaluatedAt) AS doc FROM (SELECT entityId, evaluatedAt, CASE WHEN count_if(eligible) > 0 THEN count_if(eligible)::VARCHAR END AS doc FROM candidates GROUP BY ALL) GROUP BY entityId) WHERE doc IS NOT NULL"))
def t15_materialize_eligibility(spark, sf_dir):
    n = F.count_if("eligible")
    e = T.candidates(spark, sf_dir).groupBy("entityId", "evaluatedAt").agg(F.when(n > 0, n.cast("string")).alias("doc"))
    return sequences.materialize_eligibility(e, "entityId", "evaluatedAt")


@query(T.oracle("candidates touches", f"""t AS (SELECT actionId, ts, bool_or(touchId % 4 < 2) AS on_ FROM touches WHERE channel = 'mail' GROUP BY ALL),
    c AS (SELECT actionId, ts AS eventTs, on_, lag(on_, 1, false) OVER (PARTITION BY actionId ORDER BY ts) AS was FROM t),
    r AS (SELECT actionId, min(eventTs) AS eventTs FROM c WHERE on_ AND NOT was GROUP BY ALL) SELECT DISTINCT l.entityId, l.actionId, l.channel, r.eventTs, 'SUPPRESS' AS op FROM candidates l JOIN r USING (actionId) WHERE l.active"""))
def t9_t10_fleet_suppress(spark, sf_dir):
    switched = T.touches(spark, sf_dir).where("channel = 'mail'").groupBy("actionId", F.col("ts").alias("eventTs")).agg(F.bool_or(F.col("touchId") % 4 < 2).alias("on"))
    control = switched.select("actionId", F.lit(None).cast("string").alias("channel"), "eventTs", "on")
    return sequences.fleet_suppress(control, T.candidates(spark, sf_dir).where("active"))


@query(T.oracle("sends dispositions states", """v AS (SELECT correlationId, max(CASE raw WHEN 'Delivered' THEN 1 WHEN 'Opened' THEN 2 END) AS stage FROM dispositions GROUP BY ALL)
    SELECT s.correlationId, decisionTs AS servedTs, CASE stage WHEN 1 THEN 'Delivered' WHEN 2 THEN 'Opened' END AS status, status = 'F' AS completed FROM sends s LEFT JOIN v USING (correlationId)"""))
def t21_inbound_journey(spark, sf_dir):
    serves = T.sends(spark, sf_dir).select("correlationId", F.col("decisionTs").alias("servedTs"))
    done = T.states(spark, sf_dir).where("state = 'HARD_COMPLETED'")
    return sequences.inbound_journey(serves, T.dispositions(spark, sf_dir).withColumnRenamed("raw", "status"), done, ["Delivered", "Opened", "LinkClicked"])


@query(T.oracle("candidates", """SELECT entityId, evaluatedAt, actionId, channel, place FROM (SELECT *, row_number() OVER (PARTITION BY entityId, evaluatedAt ORDER BY hardCompleted, score DESC NULLS LAST, actionId, channel) AS place FROM candidates) WHERE place <= 3"""))
def k1_k2_rank_serve(spark, sf_dir):
    return learning.rank_serve(T.candidates(spark, sf_dir), ["entityId", "evaluatedAt"], 3).select("entityId", "evaluatedAt", "actionId", "channel", "place")


@query(T.oracle("touches", "SELECT touchId, channel FROM touches WHERE (('0x' || substr(md5(touchId::VARCHAR), 1, 8))::BIGINT / 4294967295::DOUBLE) < 0.25"))
def k5_down_sample(spark, sf_dir):
    return learning.down_sample(T.touches(spark, sf_dir), F.col("touchId").cast("string"), 0.25).select("touchId", "channel")
