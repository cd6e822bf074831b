"""Queries: counters, funnels, health, experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import stable01
from tidemark.operators import joining, reports, rules
from tidemark.operators.ingest import CHANNELS, split_malformed, to_dlq, with_fact_dims
from tidemark.operators.merging import latest_per_key
from tidemark.plans.ingest import _payloads
from tidemark.plans.register import Register
from tidemark.sources import tables as T

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql

NOW, DAY, WEEK = T.NOW_MS, T.DAY_MS, 7 * T.DAY_MS


def _dims(spark, sf_dir):
    return with_fact_dims(T.fact_history(spark, sf_dir))


NET = "greatest(0, count_if(value = 'IN_PROCESS'{0}) - count_if(value IN ('FAILED', 'SUPPRESSED'){0}))"


@query(T.oracle("fact_history", f"""a AS (SELECT DISTINCT entityId, split_part(key, '.', 4) AS channel, key, eventTs, value FROM fact_history WHERE key LIKE 'nba.actionstate.%' AND eventTs BETWEEN {NOW - WEEK} AND {NOW})
    SELECT channel, {NET.format(f' AND eventTs >= {NOW - DAY}')} AS daily, {NET.format('')} AS weekly FROM a GROUP BY channel"""))
def a1_net_sends(spark, sf_dir):
    return reports.net_sends(_dims(spark, sf_dir), {"daily": NOW - DAY, "weekly": NOW - WEEK}, NOW)


@query(T.oracle("fact_history", f"""SELECT c.channel, coalesce(n, 0) AS sends FROM (SELECT unnest(['email', 'sms', 'push', 'voice', 'mail']) AS channel) c
    LEFT JOIN (SELECT split_part(key, '.', 3) AS channel, count(DISTINCT (entityId, eventTs)) AS n FROM fact_history WHERE key LIKE 'comms.sent.%' AND eventTs >= {NOW - DAY} GROUP BY ALL) s USING (channel)"""))
def a2_a3_gross_sends(spark, sf_dir):
    return reports.zero_fill(reports.gross_sends(_dims(spark, sf_dir), NOW - DAY), {"channel": list(CHANNELS)}, ["sends"])


@query(T.oracle("fact_history", f"""a AS (SELECT DISTINCT entityId, split_part(key, '.', 4) AS channel, key, eventTs FROM fact_history WHERE key LIKE 'nba.actionstate.%' AND value = 'IN_PROCESS' AND eventTs > {NOW - WEEK} AND eventTs <= {NOW})
    SELECT entityId, 'operator.comms.' || channel || 'sThisWeek' AS key, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT entityId, 'operator.comms.totalThisWeek', count(*) FROM a GROUP BY ALL"""))
def a4_comms_counts(spark, sf_dir):
    return reports.comms_counts(_dims(spark, sf_dir).where("factClass = 'actionstate'"), NOW, WEEK, "IN_PROCESS")


@query(T.oracle("facts_profile candidates sends", "SELECT (SELECT count(DISTINCT entityId) FROM facts_profile) AS members, count(DISTINCT entityId) FILTER (eligible) AS eligible, count(DISTINCT entityId) FILTER (eligible AND score IS NOT NULL) AS scored, count(DISTINCT entityId) FILTER (active) AS activated, (SELECT count(DISTINCT entityId) FROM sends) AS sent FROM candidates"))
def a5_system_stats(spark, sf_dir):
    return reports.system_stats(T.facts_profile(spark, sf_dir), T.candidates(spark, sf_dir), T.sends(spark, sf_dir))


@query(T.oracle("sends", "SELECT actionId, count(DISTINCT entityId) FILTER (status <> 'P') AS created, count(DISTINCT entityId) FILTER (status = 'P') AS suppressed, round(avg(substr(correlationId, 3)::BIGINT % 8 / 8.0::DOUBLE), 3) AS avgScore FROM sends GROUP BY actionId"))
def a6_action_stats(spark, sf_dir):
    op = F.when(F.col("status") == "P", "SUPPRESS").otherwise("CREATE")
    score = F.substring("correlationId", 3, 20).cast("long") % 8 / F.lit(8.0)
    return reports.action_stats(T.sends(spark, sf_dir).withColumns({"op": op, "score": score}))


@query(T.oracle("facts_profile facts_events", """v AS (SELECT key, value, count(*) AS n, min(valueType) AS valueType FROM (SELECT * FROM facts_profile UNION ALL SELECT * FROM facts_events) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value) AS place FROM v)
    SELECT key, min(valueType) AS valueType, count(value) AS cardinality, sum(n)::BIGINT AS n, string_agg(value, '|' ORDER BY value) FILTER (place <= 8) AS samples FROM r GROUP BY key"""))
def a7_fact_library(spark, sf_dir):
    return reports.fact_library(T.facts_profile(spark, sf_dir).unionByName(T.facts_events(spark, sf_dir)))


LATEST_SQL = "l AS (SELECT entityId, key, arg_max(value, (eventTs, value)) AS value FROM fact_history WHERE key LIKE '{0}%' GROUP BY ALL)"


@query(T.oracle("fact_history", LATEST_SQL.format("nba.disposition.") + " SELECT value, count(*) AS n FROM l GROUP BY value"))
def a8_disposition_histogram(spark, sf_dir):
    facts = T.fact_history(spark, sf_dir).where("key like 'nba.disposition.%'")
    return latest_per_key(facts, ["entityId", "key"], "eventTs", ["value"]).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


FUNNEL_ROWS = ", ".join(f"('{c}', {i}, '{s}')" for c, stages in rules.FUNNELS.items() for i, s in enumerate(stages))


@query(T.oracle("dispositions", f"""d(channel, stage, status) AS (VALUES {FUNNEL_ROWS}), s AS (SELECT channel, raw AS status, count(DISTINCT entityId) AS members FROM dispositions GROUP BY ALL)
    SELECT channel, coalesce(stage, 99) AS stage, status, coalesce(members, 0) AS members FROM s FULL JOIN d USING (channel, status)"""))
def a9_disposition_funnels(spark, sf_dir):
    return reports.disposition_funnels(T.dispositions(spark, sf_dir), rules.FUNNELS)


VARIANT = "CASE WHEN substr(entityId, 4)::BIGINT % 3 = 0 THEN 'tmpl.a' ELSE 'tmpl.b' END"


@query(T.oracle("sends dispositions", f"""s AS (SELECT actionId, {VARIANT} AS contentKey, count(DISTINCT entityId) AS sent FROM sends WHERE actionId <> 'action_0' OR substr(entityId, 4)::BIGINT % 3 = 0 GROUP BY ALL),
    d AS (SELECT actionId, {VARIANT} AS contentKey, count(DISTINCT entityId) FILTER (raw = 'Delivered') AS a, count(DISTINCT entityId) FILTER (raw = 'Opened') AS b, count(DISTINCT entityId) FILTER (raw = 'LinkClicked') AS c FROM dispositions GROUP BY ALL),
    x AS (SELECT s.*, CASE WHEN c > 0 THEN 2 WHEN b > 0 THEN 1 WHEN a > 0 THEN 0 END AS deepest, CASE WHEN c > 0 THEN c WHEN b > 0 THEN b WHEN a > 0 THEN a ELSE 0 END / sent AS conversion, count(*) OVER (PARTITION BY actionId) AS k FROM s LEFT JOIN d USING (actionId, contentKey))
    SELECT actionId, contentKey, sent, deepest, conversion, row_number() OVER (PARTITION BY actionId ORDER BY conversion DESC, sent DESC, contentKey) = 1 AS winner FROM x WHERE k > 1"""))
def a10_variant_performance(spark, sf_dir):
    third = F.substring("entityId", 4, 20).cast("long") % 3 == 0
    variant = F.when(third, "tmpl.a").otherwise("tmpl.b")
    sent = T.sends(spark, sf_dir).where((F.col("actionId") != "action_0") | third).withColumn("contentKey", variant)
    return reports.variant_performance(T.dispositions(spark, sf_dir).withColumn("contentKey", variant), sent, ["Delivered", "Opened", "LinkClicked"])


@query(T.oracle("touches", f"""c AS (SELECT channel, (ts % {DAY}) // 3600000 AS hour, count(*) AS n FROM touches WHERE ts // {DAY} * {DAY} = {NOW - 2 * DAY} GROUP BY ALL),
    g AS (SELECT DISTINCT channel, h.hour FROM touches, (SELECT unnest(range(24)) AS hour) h) SELECT channel, hour::INT AS hour, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (channel, hour)"""))
def a11_hourly_series(spark, sf_dir):
    return reports.hourly_series(T.touches(spark, sf_dir), "ts", NOW - 2 * DAY)


@query(T.oracle("touches", f"SELECT channel, count(*) AS level, CASE channel WHEN 'email' THEN 100 WHEN 'sms' THEN 30 END AS cap, round(count(*) / CASE channel WHEN 'email' THEN 100 WHEN 'sms' THEN 30 END, 4) AS utilisation, coalesce(count(*) >= CASE channel WHEN 'email' THEN 100 WHEN 'sms' THEN 30 END, false) AS throttled FROM touches WHERE ts >= {NOW - WEEK} GROUP BY channel"))
def a11_throttle_stats(spark, sf_dir):
    level = T.touches(spark, sf_dir).where(F.col("ts") >= NOW - WEEK).groupBy("channel").agg(F.count(F.lit(1)).alias("level"))
    return reports.throttle_stats(level, {"email": 100, "sms": 30})


HEALTH = """SELECT '{0}' AS layer, count_if({1} > {n} - 3600000) AS lastHour, count_if({1} > {n} - 7200000 AND {1} <= {n} - 3600000) AS previousHour, max({1}) AS lastTs,
    count_if({n} - {1} >= 86400000 AND ({n} - {1}) % 86400000 < 3600000 AND {1} >= {n} - 608400000) / 7 AS baseline FROM {2} WHERE {1} <= {n}"""
HEALTH_NOW = NOW - 2 * DAY + 12 * T.HOUR_MS


@query(T.oracle("touches fact_history", f"h AS ({HEALTH.format('touches', 'ts', 'touches', n=HEALTH_NOW)} UNION ALL {HEALTH.format('facts', 'eventTs', 'fact_history', n=HEALTH_NOW)}) SELECT *, CASE WHEN baseline >= 3 AND lastHour < 0.25 * baseline THEN 'degraded' WHEN baseline < 1 AND lastHour = 0 THEN 'quiet' ELSE 'ok' END AS status FROM h"))
def a13_layer_health(spark, sf_dir):
    return reports.layer_health(T.touches(spark, sf_dir), "touches", "ts", HEALTH_NOW).unionByName(reports.layer_health(T.fact_history(spark, sf_dir), "facts", "eventTs", HEALTH_NOW))


@query(T.oracle("sends facts_profile touches", """c AS (SELECT 'sends have members' AS name, 'sends' AS "group", (SELECT count(*) FROM sends WHERE entityId NOT IN (SELECT entityId FROM facts_profile)) AS n
    UNION ALL SELECT 'one send for each order', 'sends', (SELECT count(*) FROM (SELECT correlationId FROM sends GROUP BY ALL HAVING count(*) > 1))
    UNION ALL SELECT 'touches are recent', 'touches', (SELECT count(*) FROM touches WHERE channel = 'mail')) SELECT name, "group", n = 0 AS ok, n || ' rows' AS detail FROM c"""))
def a14_system_checks(spark, sf_dir):
    s, t = T.sends(spark, sf_dir), T.touches(spark, sf_dir)
    return reports.system_checks([
        reports.check("sends have members", "sends", s.join(T.facts_profile(spark, sf_dir).select("entityId").distinct(), "entityId", "left_anti")),
        reports.check("one send for each order", "sends", s.groupBy("correlationId").count().where("count > 1")),
        reports.check("touches are recent", "touches", t.where("channel = 'mail'")),
    ])


@query(T.oracle("candidates", "SELECT (score >= 0.2)::INT + (score >= 0.4)::INT + (score >= 0.6)::INT + (score >= 0.8)::INT AS bucket, count(*) AS n FROM candidates WHERE score IS NOT NULL GROUP BY ALL"))
def a15_score_histogram(spark, sf_dir):
    return reports.histogram(T.candidates(spark, sf_dir), "score", [0.2, 0.4, 0.6, 0.8])


@query(T.oracle("sends", "SELECT entityId AS correlationId, max(decisionTs) AS lastTs, max(actionId) FILTER (status <> 'P') AS winner, count(DISTINCT actionId) FILTER (status = 'P') AS suppressed FROM sends GROUP BY entityId ORDER BY lastTs DESC, correlationId DESC LIMIT 50"))
def a17_recent_traces(spark, sf_dir):
    s = T.sends(spark, sf_dir).select(F.col("entityId").alias("correlationId"), F.col("decisionTs").alias("ts"), "actionId", F.when(F.col("status") == "P", "SUPPRESS").otherwise("CREATE").alias("op"))
    return reports.recent_traces(s, 50)


@query(T.oracle("touches states", """SELECT t.entityId, t.actions, t.lastTs, coalesce(m.milestones, 0) AS milestones FROM (SELECT entityId, count(DISTINCT actionId) AS actions, max(ts) AS lastTs FROM touches GROUP BY ALL) t
    LEFT JOIN (SELECT entityId, count(DISTINCT actionId) AS milestones FROM states WHERE state = 'HARD_COMPLETED' GROUP BY ALL) m USING (entityId) ORDER BY milestones DESC, actions DESC, lastTs DESC, entityId LIMIT 20"""))
def a18_sample_members(spark, sf_dir):
    return reports.sample_members(T.touches(spark, sf_dir), T.states(spark, sf_dir).where("state = 'HARD_COMPLETED'"), 20)


@query(T.oracle("fact_history", LATEST_SQL.format("nba.actionstate.") + f""" SELECT s.state, coalesce(n, 0) AS n FROM (SELECT unnest({list(reports.STATES)}) AS state) s LEFT JOIN (SELECT value AS state, count(*) AS n FROM l GROUP BY ALL) c USING (state)"""))
def a19_state_rollup(spark, sf_dir):
    facts = T.fact_history(spark, sf_dir).where("key like 'nba.actionstate.%'")
    return reports.state_rollup(latest_per_key(facts, ["entityId", "key"], "eventTs", ["value"]))


@query(T.oracle("touches sends states", "SELECT 'touches' AS \"table\", count(*) AS n, count(DISTINCT entityId) AS members FROM touches UNION ALL SELECT 'sends', count(*), count(DISTINCT entityId) FROM sends UNION ALL SELECT 'states', count(*), count(DISTINCT entityId) FROM states"))
def a20_lake_status(spark, sf_dir):
    return reports.lake_status({"touches": T.touches(spark, sf_dir), "sends": T.sends(spark, sf_dir), "states": T.states(spark, sf_dir)})


ARM = "(('0x' || substr(md5(entityId || '|ab1'), 1, 8))::BIGINT / 4294967295::DOUBLE) < 0.3"
A, B, C, D, E = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429


@query(T.oracle("sends", f"""m AS (SELECT entityId, bool_or(status = 'F' AND channel = 'email') AS reached FROM sends GROUP BY ALL), s AS (SELECT count_if({ARM}) AS n_t, count_if(NOT {ARM}) AS n_c, count_if({ARM} AND reached) AS x_t, count_if(NOT {ARM} AND reached) AS x_c FROM m),
    r AS (SELECT *, x_t / n_t AS rate_t, x_c / n_c AS rate_c, (x_t + x_c) / (n_t + n_c) AS q FROM s), z AS (SELECT *, (rate_t - rate_c) / sqrt(q * (1 - q) * (1 / n_t + 1 / n_c)) AS z FROM r),
    y AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2.0::DOUBLE)) AS t FROM z), p AS (SELECT *, t * ({A}::DOUBLE + t * ({B}::DOUBLE + t * ({C}::DOUBLE + t * ({D}::DOUBLE + t * {E}::DOUBLE)))) * exp(-x * x) AS p FROM y)
    SELECT n_t, n_c, rate_t, rate_c, rate_t - rate_c AS lift, round(z, 9) AS z, round(p, 9) AS p, p < 0.05 AS significant FROM p"""))
def a25_ab_readout(spark, sf_dir):
    m = T.sends(spark, sf_dir).groupBy("entityId").agg(F.max((F.col("status") == "F") & (F.col("channel") == "email")).alias("reached"))
    out = reports.ab_readout(m, stable01(F.col("entityId"), F.lit("ab1")) < 0.3, F.col("reached"))
    return out.withColumns({c: F.round(c, 9) for c in ("z", "p")})


@query(T.oracle("states", """f AS (SELECT entityId, channel, bool_or(state = 'PRESENTED') AS soft, max((state = 'HARD_COMPLETED')::INT) AS hard FROM states WHERE actionId IN ('action_1', 'action_2') GROUP BY ALL)
    SELECT channel, avg(hard) FILTER (soft) AS warm, avg(hard) FILTER (NOT soft) AS cold, avg(hard) FILTER (soft) - avg(hard) FILTER (NOT soft) AS lift FROM f GROUP BY channel"""))
def a26_warm_lift(spark, sf_dir):
    return reports.warm_lift(T.states(spark, sf_dir).where("actionId in ('action_1', 'action_2')"))


@query("SELECT 'reader-' || (conv_id % 2) AS consumer, count(*) AS depth, 'not a JSON object' AS lastError FROM conversations WHERE (conv_id + turn) % 7 = 0 GROUP BY ALL")
def a31_dlq_stats(spark, sf_dir):
    _, bad = split_malformed(_payloads(spark, sf_dir), "value", "role STRING, turn LONG")
    dlq = to_dlq(bad, "reader", NOW).withColumn("consumer", F.concat(F.lit("reader-"), (F.col("key").cast("long") % 2).cast("string")))
    return reports.dlq_stats(dlq)


@query(T.oracle("touches", f"""v AS (SELECT entityId, touchId, ts FROM touches WHERE channel = 'voice'), u AS (SELECT DISTINCT entityId, ts AS upTs FROM touches WHERE channel <> 'voice'), h AS (SELECT ts, ts - upTs AS latency FROM v ASOF JOIN u ON v.entityId = u.entityId AND v.ts >= u.upTs WHERE ts - upTs <= {DAY})
    SELECT ts // {DAY} * {DAY} AS windowStart, count(*) AS events, count(*) * 1000 / {DAY} AS perSecond, CASE WHEN count(*) >= 3 THEN quantile_disc(latency, 0.5) END AS p50, CASE WHEN count(*) >= 3 THEN avg(latency) END AS mean, CASE WHEN count(*) >= 3 THEN quantile_disc(latency, 0.95) END AS p95 FROM h GROUP BY ts // {DAY} * {DAY}"""))
def a32_stage_metrics(spark, sf_dir):
    t = T.touches(spark, sf_dir)
    hops = joining.hop_latency(t.where("channel = 'voice'").select("entityId", "touchId", "ts"), t.where("channel <> 'voice'").select("entityId", F.col("ts").alias("upTs")), ["entityId"], DAY)
    return reports.stage_metrics(hops, "ts", DAY)


@query(T.oracle("touches", f"SELECT max(ts) AS lastTs, {NOW} - max(ts) AS age, {NOW} - max(ts) <= 3600000 AS fresh FROM touches"))
def a33_freshness(spark, sf_dir):
    return reports.freshness(T.touches(spark, sf_dir), "ts", NOW, T.HOUR_MS)


@query(T.oracle("facts_events facts_profile", "SELECT entityId, key, value FROM facts_events WHERE key IN ('operator.activity.purchase', 'operator.activity.view')"))
def a34_reconcile_facts(spark, sf_dir):
    f = T.facts_events(spark, sf_dir)
    used = f.where("key in ('operator.activity.purchase', 'operator.activity.view', 'operator.activity.click')").select("key").distinct()
    known = f.where("key in ('operator.activity.click', 'operator.activity.error')").select("key").distinct()
    _, _, backfill = reports.reconcile_facts(used, known, f)
    return backfill.select("entityId", "key", "value")


@query(T.oracle("facts_profile touches states", """t AS (SELECT entityId, ts, 'touch' AS kind, actionId, channel, touchId::VARCHAR AS detail FROM touches UNION ALL SELECT entityId, stTs, 'state', actionId, channel, state FROM states),
    x AS (SELECT entityId, string_agg(ts || kind || actionId || channel || detail, ';' ORDER BY ts, kind, actionId, channel, detail) AS timeline FROM t GROUP BY ALL) SELECT entityId, md5(timeline) AS timeline, count(*) AS facts FROM facts_profile LEFT JOIN x USING (entityId) GROUP BY ALL"""))
def a35_member_document(spark, sf_dir):
    touch = T.touches(spark, sf_dir).select("entityId", "ts", "actionId", "channel", F.col("touchId").cast("string").alias("detail"))
    state = T.states(spark, sf_dir).select("entityId", F.col("stTs").alias("ts"), "actionId", "channel", F.col("state").alias("detail"))
    doc = reports.member_document(T.facts_profile(spark, sf_dir), [("touch", touch), ("state", state)])
    shown = F.array_join(F.transform("timeline", lambda e: F.concat(e["ts"].cast("string"), e["kind"], e["actionId"], e["channel"], e["detail"])), ";")
    return doc.select("entityId", F.md5(shown).alias("timeline"), F.size("facts").cast("long").alias("facts"))


@query(T.oracle("touches sends", "SELECT * FROM (SELECT 'touch' AS kind, ts, entityId, actionId AS detail FROM touches UNION ALL SELECT 'send', decisionTs, entityId, status FROM sends) ORDER BY ts DESC, kind, entityId, detail LIMIT 100"))
def k3_live_feed(spark, sf_dir):
    touch = T.touches(spark, sf_dir).select(F.lit("touch").alias("kind"), "ts", "entityId", F.col("actionId").alias("detail"))
    send = T.sends(spark, sf_dir).select(F.lit("send").alias("kind"), F.col("decisionTs").alias("ts"), "entityId", F.col("status").alias("detail"))
    return reports.live_feed([touch, send], 100)


@query(T.oracle("fact_history", """SELECT source, CASE source WHEN 'ml' THEN 'ml' WHEN 'temporal' THEN 'temporal' WHEN 'action-layer' THEN 'action' ELSE 'lake' END AS emitter, count(*) AS n FROM fact_history GROUP BY ALL"""))
def p33_emitters(spark, sf_dir):
    f = T.fact_history(spark, sf_dir)
    emitter = reports.emitter_of(F.lit("nba.member.facts"), F.col("source"), F.lit(None).cast("string"))
    return f.select("source", emitter.alias("emitter")).groupBy("source", "emitter").agg(F.count(F.lit(1)).alias("n"))
