"""Queries: joins in time and by identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import joining
from tidemark.operators.ingest import pivot_features
from tidemark.plans.ingest import FEATURES
from tidemark.plans.register import Register
from tidemark.sources import tables as T

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql


def idmap(spark, sf_dir):
    e = T.facts_profile(spark, sf_dir).select("entityType", "entityId").distinct()
    return e.withColumn("nbaId", joining.member_id(F.col("entityType"), F.col("entityId")))


IDS = "ids AS (SELECT DISTINCT entityType, entityId, 'nba_' || substr(sha256(entityType || ':' || entityId), 1, 12) AS nbaId FROM facts_profile)"


@query(T.oracle("facts_profile touches", IDS + " SELECT t.entityId, touchId, nbaId FROM touches t LEFT JOIN ids USING (entityId)"))
def j1_attach_nba_id(spark, sf_dir):
    return joining.attach_nba_id(T.touches(spark, sf_dir), idmap(spark, sf_dir)).select("entityId", "touchId", "nbaId")


@query(T.oracle("facts_profile facts_events", IDS + " SELECT entityType, entityId, nbaId FROM ids"))
def j2_mint_ids(spark, sf_dir):
    known = idmap(spark, sf_dir).where("entityId < 'op-3'")
    return joining.mint_ids(T.facts_profile(spark, sf_dir).unionByName(T.facts_events(spark, sf_dir)), known)


@query(T.oracle("facts_profile", IDS + """ SELECT entityId AS anyId, * FROM ids WHERE entityId LIKE '%7' UNION ALL SELECT nbaId, * FROM ids WHERE entityId LIKE '%3'"""))
def j19_lookup_identity(spark, sf_dir):
    ids = idmap(spark, sf_dir)
    wanted = ids.where("entityId like '%7'").select(F.col("entityId").alias("anyId")).unionByName(ids.where("entityId like '%3'").select(F.col("nbaId").alias("anyId")))
    return joining.lookup_identity(ids, wanted)


def _decisions(spark, sf_dir):
    return T.touches(spark, sf_dir).where("channel = 'voice'").select("entityId", "touchId", "actionId", F.col("ts").alias("decisionTs"))


def _snapshots(spark, sf_dir):
    return T.touches(spark, sf_dir).where("channel = 'push'").groupBy("entityId", F.col("ts").alias("snapTs")).agg(F.max("touchId").alias("snapId"))


SNAPS = "d AS (SELECT entityId, touchId, actionId, ts AS decisionTs FROM touches WHERE channel = 'voice'), s AS (SELECT entityId, ts AS snapTs, max(touchId) AS snapId FROM touches WHERE channel = 'push' GROUP BY ALL)"


@query(T.oracle("touches", SNAPS + " SELECT d.*, s.snapTs, s.snapId FROM d ASOF JOIN s ON d.entityId = s.entityId AND d.decisionTs >= s.snapTs"))
def j3_asof_features(spark, sf_dir):
    return joining.asof_features(_decisions(spark, sf_dir), _snapshots(spark, sf_dir), ["entityId"], "decisionTs", "snapTs", ["snapId"])


@query(T.oracle("touches", SNAPS + """, a AS (SELECT entityId, touchId, actionId, decisionTs // 86400000 * 86400000 AS decisionTs FROM d), b AS (SELECT entityId, snapTs // 86400000 * 86400000 AS snapTs, max(snapId) AS snapId FROM s GROUP BY ALL)
    SELECT a.*, b.snapTs, b.snapId FROM a ASOF LEFT JOIN b ON a.entityId = b.entityId AND a.decisionTs > b.snapTs"""))
def j4_asof_strict(spark, sf_dir):
    day = lambda c: (F.floor(F.col(c) / T.DAY_MS) * T.DAY_MS).cast("long")
    d = _decisions(spark, sf_dir).withColumn("decisionTs", day("decisionTs"))
    s = _snapshots(spark, sf_dir).withColumn("snapTs", day("snapTs"))
    return joining.asof_join(d, s, ["entityId"], "decisionTs", "snapTs", ["snapId"], strict=True)


EPISODE_BY = ["entityId", "actionId", "channel"]


@query(T.oracle("sends states", """b AS (SELECT entityId, actionId, channel, decisionTs, max(correlationId) AS correlationId FROM sends GROUP BY ALL), n AS (SELECT *, lead(decisionTs) OVER (PARTITION BY entityId, actionId, channel ORDER BY decisionTs) AS nextTs FROM b)
    SELECT s.entityId, s.actionId, s.channel, s.state, s.stTs, n.decisionTs, n.correlationId FROM states s JOIN n ON s.entityId = n.entityId AND s.actionId = n.actionId AND s.channel = n.channel AND n.decisionTs <= s.stTs AND (n.nextTs IS NULL OR s.stTs < n.nextTs)"""))
def j5_w2_episode_states(spark, sf_dir):
    return joining.episode_states(T.sends(spark, sf_dir), T.states(spark, sf_dir).drop("correlationId"), EPISODE_BY)


@query(T.oracle("candidates", "SELECT entityId, evaluatedAt, actionId, channel FROM candidates WHERE correlationId NOT IN (SELECT correlationId FROM candidates WHERE eligible AND NOT active AND NOT hardCompleted AND score IS NOT NULL)"))
def j6_holds(spark, sf_dir):
    c = T.candidates(spark, sf_dir)
    sent = c.where("eligible and not active and not hardCompleted and score is not null")
    return joining.holds(c, sent).select("entityId", "evaluatedAt", "actionId", "channel")


@query(T.oracle("sends dispositions", "SELECT correlationId, decisionTs, count(eventTs) AS n, min(eventTs) AS firstTs FROM sends LEFT JOIN dispositions USING (correlationId) GROUP BY ALL"))
def j7_send_features(spark, sf_dir):
    d = T.dispositions(spark, sf_dir).groupBy("correlationId").agg(F.count("eventTs").alias("n"), F.min("eventTs").alias("firstTs"))
    return T.sends(spark, sf_dir).select("correlationId", "decisionTs").join(d, "correlationId", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(T.oracle("sends candidates", """l AS (SELECT entityId, actionId, avg(score) AS propensity FROM candidates WHERE score > 0.5 GROUP BY ALL)
    SELECT s.correlationId, round(coalesce(l.propensity, 0.5), 9) AS propensity FROM sends s LEFT JOIN l ON s.entityId = l.entityId AND s.actionId = l.actionId"""))
def j8_attach_propensity(spark, sf_dir):
    log = T.candidates(spark, sf_dir).where("score > 0.5").select("entityId", "actionId", F.col("score").alias("propensity"))
    return joining.attach_propensity(T.sends(spark, sf_dir), log, ["entityId", "actionId"]).select("correlationId", F.round("propensity", 9).alias("propensity"))


@query(T.oracle("sends candidates", "SELECT DISTINCT entityId, actionId, channel FROM sends s WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE eligible AND c.entityId = s.entityId AND c.actionId = s.actionId AND c.channel = s.channel)"))
def j9_orphan_activations(spark, sf_dir):
    return joining.orphan_activations(T.sends(spark, sf_dir), T.candidates(spark, sf_dir).where("eligible"), EPISODE_BY)


@query(T.oracle("candidates sends dispositions", """a AS (SELECT DISTINCT actionId FROM candidates), e AS (SELECT actionId, count(DISTINCT entityId) AS eligible, round(avg(score), 3) AS avgScore FROM candidates WHERE eligible GROUP BY ALL),
    s AS (SELECT actionId, count(DISTINCT entityId) AS sent FROM sends GROUP BY ALL), d AS (SELECT actionId, count(DISTINCT entityId) AS opened FROM dispositions WHERE raw = 'Opened' GROUP BY ALL)
    SELECT actionId, coalesce(eligible, 0) AS eligible, avgScore, coalesce(sent, 0) AS sent, coalesce(opened, 0) AS opened FROM a LEFT JOIN e USING (actionId) LEFT JOIN s USING (actionId) LEFT JOIN d USING (actionId)"""))
def j10_action_performance(spark, sf_dir):
    c = T.candidates(spark, sf_dir)
    members = lambda df, n: df.groupBy("actionId").agg(F.count_distinct("entityId").alias(n))
    eligible = c.where("eligible").groupBy("actionId").agg(F.count_distinct("entityId").alias("eligible"), F.round(F.avg("score"), 3).alias("avgScore"))
    out = c.select("actionId").distinct().join(eligible, "actionId", "left").join(members(T.sends(spark, sf_dir), "sent"), "actionId", "left")
    out = out.join(members(T.dispositions(spark, sf_dir).where("raw = 'Opened'"), "opened"), "actionId", "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("eligible", "sent", "opened")})


@query(T.oracle("touches facts_profile", "SELECT entityId, key, value FROM facts_profile WHERE entityId IN (SELECT entityId FROM touches WHERE ts // 86400000 = (SELECT max(ts) // 86400000 FROM touches))"))
def j14_scope_to(spark, sf_dir):
    touches = T.touches(spark, sf_dir).withColumn("day", F.expr("ts div 86400000"))
    latest = touches.join(F.broadcast(touches.agg(F.max("day").alias("day"))), "day")  # one row
    return joining.scope_to(T.facts_profile(spark, sf_dir), latest, "entityId").select("entityId", "key", "value")


@query(T.oracle("candidates sends dispositions", """w AS (SELECT correlationId FROM sends WHERE status = 'F'), x AS (SELECT correlationId, decisionTs AS ts, 'activation' AS kind, actionId, channel, 'CREATE' AS detail FROM sends
    UNION ALL SELECT correlationId, eventTs, 'disposition', actionId, channel, raw FROM dispositions) SELECT correlationId, count(*) AS n, string_agg(ts || kind || detail, ',' ORDER BY ts, kind, actionId, channel, detail) AS steps FROM x WHERE correlationId IN (SELECT * FROM w) GROUP BY ALL"""))
def j15_trace(spark, sf_dir):
    s = T.sends(spark, sf_dir)
    acts = s.select("correlationId", F.col("decisionTs").alias("ts"), "actionId", "channel", F.lit("CREATE").alias("op"))
    found = joining.trace(s.where("status = 'F'").select("correlationId"), acts, T.candidates(spark, sf_dir), T.dispositions(spark, sf_dir))
    shown = F.array_join(F.transform("steps", lambda x: F.concat(x["ts"].cast("string"), x["kind"], x["detail"])), ",")
    return found.select("correlationId", F.size("steps").cast("long").alias("n"), shown.alias("steps"))


@query(T.oracle("sends facts_profile", """p AS (SELECT entityId, max(CASE WHEN key LIKE '%isDNC' AND value = 'true' THEN 1.0 ELSE 0.0 END)::DOUBLE AS isDNC, max(CASE WHEN key LIKE '%balance' THEN value::DOUBLE END) AS balance FROM facts_profile WHERE entityId NOT LIKE '%9' GROUP BY ALL)
    SELECT correlationId, coalesce(isDNC, 0) AS isDNC, coalesce(balance, 0) AS balance FROM sends LEFT JOIN p USING (entityId)"""))
def j17_overlay_profile(spark, sf_dir):
    p = pivot_features(T.facts_profile(spark, sf_dir).where("entityId not like '%9'"), "entityId", FEATURES)
    return joining.overlay_profile(T.sends(spark, sf_dir), p, "entityId", ["isDNC", "balance"]).select("correlationId", "isDNC", "balance")


@query(T.oracle("facts_events facts_profile", """a AS (SELECT entityId, key, value, eventTs, 0 AS layer FROM facts_events UNION ALL SELECT entityId, key, value, eventTs, 0 FROM facts_profile UNION ALL SELECT entityId, key, 'req', 1705363200000, 1 FROM facts_events UNION ALL SELECT entityId, key, 'same', eventTs, 2 FROM facts_profile)
    SELECT entityId, key, r.value, r.eventTs, r.layer FROM (SELECT entityId, key, arg_max({'value': value, 'eventTs': eventTs, 'layer': layer}, (eventTs, layer, value)) AS r FROM a GROUP BY ALL)"""))
def j18_merge_layers(spark, sf_dir):
    events, profile = T.facts_events(spark, sf_dir), T.facts_profile(spark, sf_dir)
    request = events.select("entityId", "key", F.lit("req").alias("value"), F.lit(1705363200000).alias("eventTs"))
    return joining.merge_layers([events.unionByName(profile), request, profile.withColumn("value", F.lit("same"))], ["entityId"])


@query(T.oracle("touches", """v AS (SELECT entityId, touchId, ts FROM touches WHERE channel = 'voice'), u AS (SELECT DISTINCT entityId, ts AS upTs FROM touches WHERE channel <> 'voice')
    SELECT v.entityId, touchId, ts, upTs, ts - upTs AS latency FROM v ASOF JOIN u ON v.entityId = u.entityId AND v.ts >= u.upTs WHERE ts - upTs <= 86400000"""))
def j20_hop_latency(spark, sf_dir):
    t = T.touches(spark, sf_dir)
    return joining.hop_latency(t.where("channel = 'voice'").select("entityId", "touchId", "ts"), t.where("channel <> 'voice'").select("entityId", F.col("ts").alias("upTs")), ["entityId"], T.DAY_MS)


@query(T.oracle("candidates", "SELECT c.entityId, c.evaluatedAt, c.actionId, d.n FROM (SELECT DISTINCT entityId, evaluatedAt, actionId FROM candidates WHERE hardCompleted) c LEFT JOIN (SELECT actionId, count(DISTINCT channel) AS n FROM candidates GROUP BY ALL) d USING (actionId)"))
def j16_member_milestones(spark, sf_dir):
    c = T.candidates(spark, sf_dir)
    defs = c.groupBy("actionId").agg(F.count_distinct("channel").alias("n"))
    return c.where("hardCompleted").select("entityId", "evaluatedAt", "actionId").distinct().join(defs, "actionId", "left")
