"""Queries: eligibility, completion, content, arbitration and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.conditions import facts_used
from tidemark.functions.scalars import percent_bucket
from tidemark.operators import rules
from tidemark.operators.ingest import member_fact_map
from tidemark.plans.register import Register
from tidemark.sources import tables as T

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql


def _leaf(fact, cmp, value=None):
    return {"fact": fact, "cmp": cmp, "value": value}


PURCHASES = {"op": "all", "conditions": [_leaf("operator.activity.purchase", "gt", 10)]}
BROWSING = {"op": "any", "conditions": [_leaf("operator.activity.view", "gte", 4.5), {"op": "all", "conditions": [_leaf("operator.activity.signup", "exists"), _leaf("operator.profile.segment", "in", ["BUILDING", "MACHINERY"])]}]}
NO_DNC = {"op": "all", "conditions": [_leaf("operator.profile.isDNC", "eq", False)]}
CONSENT = {"op": "all", "conditions": [_leaf("operator.profile.smsConsent", "eq", True)]}
DEFS = {
    "actions": [
        {"id": "action_1", "channels": [{"channel": "email"}, {"channel": "sms"}], "inclusion": PURCHASES},
        {"id": "action_2", "channels": [{"channel": "sms"}, {"channel": "push"}], "inclusion": BROWSING, "exclusion": {"op": "all", "conditions": [_leaf("operator.activity.error", "gt", 8)]}},
        {"id": "action_3", "channels": [{"channel": "mail"}], "inclusion": {"op": "all", "conditions": []}},
    ],
    "globals": [{"name": "No DNC", "logic": NO_DNC}],
    "channels": [
        {"channel": "sms", "name": "SMS consent", "logic": CONSENT},
        {"channel": "email", "name": "Email rate", "logic": {"op": "all", "conditions": [_leaf("nba.throttle.email.rate", "lt", 50), _leaf("nba.throttle.email.daily", "lte", 400)]}},
        {"channel": "sms", "name": "SMS rate", "logic": {"op": "all", "conditions": [_leaf("nba.throttle.sms.rate", "lt", 20)]}},
    ],
}
MAX_BATCH = {"email": 2, "push": 3}


def members(spark, sf_dir):
    return member_fact_map(T.facts_events(spark, sf_dir).unionByName(T.facts_profile(spark, sf_dir)))


MEMBERS = """latest AS (SELECT entityId, key, arg_max(value, (eventTs, value)) AS value FROM (SELECT * FROM facts_events UNION ALL SELECT * FROM facts_profile) GROUP BY ALL),
    m AS (SELECT entityId, coalesce(max(CASE WHEN key = 'operator.activity.purchase' THEN value::DOUBLE END), 0) AS purchase, coalesce(max(CASE WHEN key = 'operator.activity.view' THEN value::DOUBLE END), 0) AS views,
        coalesce(max(CASE WHEN key = 'operator.activity.error' THEN value::DOUBLE END), 0) AS errors, bool_or(key = 'operator.activity.signup') AS signup, bool_or(key = 'operator.profile.isDNC' AND value = 'true') AS dnc,
        bool_or(key = 'operator.profile.smsConsent' AND value = 'true') AS consent, coalesce(max(CASE WHEN key = 'operator.profile.segment' THEN value END), '') AS segment FROM latest GROUP BY entityId),
    g AS (SELECT *, views >= 4.5 OR (signup AND segment IN ('BUILDING', 'MACHINERY')) AS browsing FROM m)"""


@query(T.oracle("facts_events facts_profile", MEMBERS + """
    SELECT entityId, 'action_1' AS actionId, 'email' AS channel FROM g WHERE NOT dnc AND purchase > 10 UNION ALL SELECT entityId, 'action_1', 'sms' FROM g WHERE NOT dnc AND purchase > 10 AND consent
    UNION ALL SELECT entityId, 'action_2', 'sms' FROM g WHERE NOT dnc AND browsing AND errors <= 8 AND consent UNION ALL SELECT entityId, 'action_2', 'push' FROM g WHERE NOT dnc AND browsing AND errors <= 8
    UNION ALL SELECT entityId, 'action_3', 'mail' FROM g WHERE NOT dnc"""))
def p24_p25_j11_eligible_hits(spark, sf_dir):
    return rules.eligible_hits(members(spark, sf_dir), DEFS)


STAGES = [("members", None), ("inclusion", PURCHASES), ("No DNC", NO_DNC), ("SMS consent", CONSENT)]


@query(T.oracle("facts_events facts_profile", MEMBERS + """
    SELECT 0 AS stage, 'members' AS label, count(*) AS members FROM g UNION ALL SELECT 1, 'inclusion', count(*) FROM g WHERE purchase > 10
    UNION ALL SELECT 2, 'No DNC', count(*) FROM g WHERE purchase > 10 AND NOT dnc UNION ALL SELECT 3, 'SMS consent', count(*) FROM g WHERE purchase > 10 AND NOT dnc AND consent"""))
def a16_rule_funnel(spark, sf_dir):
    return rules.rule_funnel(members(spark, sf_dir), STAGES)


@query(T.oracle("facts_events facts_profile", MEMBERS + """, p AS (SELECT entityId, max(value) AS shown FROM latest WHERE key = 'operator.activity.purchase' GROUP BY ALL)
    SELECT g.entityId, 'operator.activity.purchase ' || coalesce(p.shown, '(default)') || ' gt 10' AS firstCheck, CASE WHEN purchase <= 10 THEN 'inclusion' WHEN dnc THEN 'No DNC' WHEN NOT consent THEN 'SMS consent' END AS blockedAt, 3 AS checks FROM g LEFT JOIN p USING (entityId)"""))
def p35_explain(spark, sf_dir):
    found = rules.explain(members(spark, sf_dir), DEFS["actions"][0], "sms", DEFS)
    return found.select("entityId", F.col("checks")[0]["detail"].alias("firstCheck"), "blockedAt", F.size("checks").alias("checks"))


@query(T.oracle("dispositions", """SELECT entityId, actionId, channel, raw, CASE channel WHEN 'email' THEN raw = 'Opened' WHEN 'push' THEN raw = 'Opened' WHEN 'mail' THEN raw = 'Delivered' WHEN 'sms' THEN raw = 'Delivered' ELSE false END AS soft, count(*) AS n FROM dispositions GROUP BY ALL"""))
def p26_soft_completed(spark, sf_dir):
    d = T.dispositions(spark, sf_dir)
    bar = F.when(F.col("channel") == "email", "Opened").when(F.col("channel") == "sms", "Delivered").when(F.col("channel") == "voice", "Completed")
    return d.withColumn("soft", rules.soft_completed(F.col("channel"), F.col("raw"), bar)).groupBy("entityId", "actionId", "channel", "raw", "soft").agg(F.count(F.lit(1)).alias("n"))


def _java_hash_sql(text: str) -> str:
    return f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"


@query(T.oracle("facts_events facts_profile", MEMBERS + f""", h AS (SELECT *, {_java_hash_sql("entityId || ':action_1'")} AS u FROM g),
    b AS (SELECT *, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS s FROM h), c AS (SELECT *, ((s % 100) + 100) % 100 AS bucket FROM b)
    SELECT entityId, bucket, CASE WHEN purchase > 10 AND bucket < 100 THEN 'tmpl.buyer' WHEN bucket < 30 THEN 'tmpl.test' ELSE 'tmpl.base' END AS contentKey FROM c"""))
def p27_f20_content_variants(spark, sf_dir):
    m = members(spark, sf_dir)
    variants = [{"contentKey": "tmpl.buyer", "conditions": PURCHASES}, {"contentKey": "tmpl.test", "percent": 30}]
    who = F.col("entityId")
    return m.select("entityId", percent_bucket(F.concat_ws(":", who, F.lit("action_1"))).alias("bucket"), rules.content_key(who, F.col("facts"), "tmpl.base", variants, "action_1").alias("contentKey"))


@query(T.oracle("candidates", """SELECT entityId, evaluatedAt, actionId, channel, score > 0.8 OR hardCompleted AS completed, coalesce(score > 0.8, false) AND NOT hardCompleted AS newlyCompleted,
    (coalesce(score > 0.8, false) OR hardCompleted) AND NOT coalesce(workflowState IN ('CREATED', 'IN_PROCESS', 'SUPPRESSING', 'PRESENTED', 'SOFT_COMPLETED', 'DECLINED'), false) AS autoExcluded
    FROM (SELECT * REPLACE (coalesce(score, 0) AS score) FROM candidates)"""))
def p28_completion_flags(spark, sf_dir):
    c = T.candidates(spark, sf_dir)
    flags = rules.completion_flags(F.coalesce(F.col("score") > 0.8, F.lit(False)), F.col("hardCompleted"), F.col("workflowState"), F.lit(None).cast("boolean"))
    return c.select("entityId", "evaluatedAt", "actionId", "channel", flags["completed"].alias("completed"), flags["newly_completed"].alias("newlyCompleted"), flags["auto_excluded"].alias("autoExcluded"))


@query(T.oracle("dispositions", "SELECT DISTINCT entityId, channel FROM dispositions WHERE channel = 'email' AND raw = 'Unsubscribe'"))
def p29_opted_out(spark, sf_dir):
    return rules.opted_out(T.dispositions(spark, sf_dir))


@query(T.oracle("candidates", "SELECT entityId, evaluatedAt, actionId, channel FROM candidates WHERE actionId <> 'action_4' AND NOT (actionId = 'action_7' AND channel = 'email')"))
def p30_strip_suppressed(spark, sf_dir):
    c = T.candidates(spark, sf_dir)
    pulled = c.where("actionId = 'action_4'").select("actionId", F.lit(None).cast("string").alias("channel")).unionByName(c.where("actionId = 'action_7' and channel = 'email'").select("actionId", "channel"))
    return rules.strip_suppressed(c, pulled).select("entityId", "evaluatedAt", "actionId", "channel")


@query(T.oracle("candidates facts_profile touches", f"""w AS (SELECT entityId, count(*) AS n FROM touches WHERE ts >= {T.NOW_MS - 7 * T.DAY_MS} GROUP BY ALL)
    SELECT c.entityId, evaluatedAt, actionId, channel FROM candidates c LEFT JOIN w ON w.entityId = c.entityId WHERE substr(c.entityId, 4)::BIGINT % 33 <> 0 AND (channel <> 'sms' OR substr(c.entityId, 4)::BIGINT % 7 <> 0) AND coalesce(n, 0) < 12 AND actionId <> 'action_2'"""))
def p31_compliance_gate(spark, sf_dir):
    week = T.touches(spark, sf_dir).where(F.col("ts") >= T.NOW_MS - 7 * T.DAY_MS).groupBy("entityId").agg(F.count(F.lit(1)).alias("n"))
    p = members(spark, sf_dir).join(week, "entityId", "left")
    profile = p.select("entityId", *(F.coalesce(F.try_element_at("facts", F.lit(f"operator.profile.{x}")) == "true", F.lit(False)).alias(x) for x in ("isDNC", "smsConsent")), F.coalesce("n", F.lit(0)).alias("contactsThisWeek"), F.array(F.lit("action_2")).alias("achieved"))
    return rules.compliance_gate(T.candidates(spark, sf_dir), profile, 12).select("entityId", "evaluatedAt", "actionId", "channel")


@query(T.oracle("fact_history", """u AS (SELECT DISTINCT CASE WHEN key LIKE 'operator.profile.%' THEN key ELSE 'operator.activity.view' END AS fact, valueType FROM fact_history WHERE key LIKE 'operator.%')
    SELECT 'check' AS id, key AS fact, 'gt' AS cmp, CASE valueType WHEN 'BOOLEAN' THEN 'bool' ELSE 'string' END AS type FROM (SELECT DISTINCT key, valueType FROM fact_history WHERE key LIKE 'operator.%' AND valueType <> 'DOUBLE')"""))
def p18_validate_definitions(spark, sf_dir):
    kind = F.when(F.col("valueType") == "BOOLEAN", "bool").when(F.col("valueType") == "STRING", "string").otherwise("number")
    declared = T.fact_history(spark, sf_dir).where("key like 'operator.%'").select(F.col("key").alias("fact"), kind.alias("type")).distinct()
    used = declared.select(F.lit("check").alias("id"), "fact", F.lit("gt").alias("cmp"))
    return rules.validate_definitions(used, declared)


BEST = """best AS (SELECT entityId, evaluatedAt,
        arg_min(actionId || '::' || channel, (-coalesce(score, '-infinity'::DOUBLE), actionId || '::' || channel)) FILTER (eligible AND active) AS occ,
        arg_min(coalesce(score, '-infinity'::DOUBLE), (-coalesce(score, '-infinity'::DOUBLE), actionId || '::' || channel)) FILTER (eligible AND active) AS occScore,
        arg_min(cancellable, (-coalesce(score, '-infinity'::DOUBLE), actionId || '::' || channel)) FILTER (eligible AND active) AS occOpen,
        arg_min(actionId || '::' || channel, (-score, actionId || '::' || channel)) FILTER (eligible AND NOT active AND NOT hardCompleted AND score IS NOT NULL) AS cand,
        max(score) FILTER (eligible AND NOT active AND NOT hardCompleted) AS candScore FROM candidates GROUP BY entityId, evaluatedAt)"""
BY = ["entityId", "evaluatedAt"]


@query(T.oracle("candidates", BEST + " SELECT entityId, evaluatedAt, occ AS occupant, cand AS candidate FROM best"))
def w8_arbitrate_slot(spark, sf_dir):
    slots = rules.arbitrate_slot(T.candidates(spark, sf_dir), BY)
    slug = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("::", f"{c}.actionId", f"{c}.channel")).alias(c)
    return slots.select(*BY, slug("occupant"), slug("candidate"))


@query(T.oracle("candidates", BEST + """ SELECT entityId, evaluatedAt, actionId, channel, place FROM (SELECT c.*, row_number() OVER (PARTITION BY c.entityId, c.evaluatedAt ORDER BY score DESC, actionId) AS place
    FROM candidates c JOIN best b ON b.entityId = c.entityId AND b.evaluatedAt = c.evaluatedAt AND b.occ IS NULL AND split_part(b.cand, '::', 2) = c.channel
    WHERE eligible AND NOT active AND NOT hardCompleted AND score IS NOT NULL) WHERE place <= CASE channel WHEN 'email' THEN 2 WHEN 'push' THEN 3 ELSE 1 END"""))
def w9_k2_select_batch(spark, sf_dir):
    return rules.select_batch(T.candidates(spark, sf_dir), BY, MAX_BATCH).select(*BY, "actionId", "channel", "place")


@query(T.oracle("candidates", "open AS (SELECT * FROM candidates WHERE actionId <> 'action_4' AND NOT (actionId = 'action_7' AND channel = 'email')), " + BEST.replace("FROM candidates", "FROM open") + """,
    batch AS (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY o.entityId, o.evaluatedAt ORDER BY score DESC, actionId) AS place FROM open o JOIN best b ON b.entityId = o.entityId AND b.evaluatedAt = o.evaluatedAt AND b.occ IS NULL AND split_part(b.cand, '::', 2) = o.channel
        WHERE eligible AND NOT active AND NOT hardCompleted AND score IS NOT NULL) WHERE place <= CASE channel WHEN 'email' THEN 2 WHEN 'push' THEN 3 ELSE 1 END),
    made AS (SELECT entityId, evaluatedAt, channel, list(actionId ORDER BY place) AS l FROM batch GROUP BY ALL)
    SELECT entityId, evaluatedAt, CASE WHEN hardCompleted THEN 'HARD_COMPLETE' ELSE 'SOFT_COMPLETE' END AS op, actionId, channel, NULL AS actions FROM open WHERE hardCompleted OR softCompleted
    UNION ALL SELECT entityId, evaluatedAt, 'SUPPRESS', actionId, channel, NULL FROM candidates WHERE NOT eligible AND cancellable
    UNION ALL SELECT entityId, evaluatedAt, 'SUPPRESS', split_part(occ, '::', 1), split_part(occ, '::', 2), NULL FROM best WHERE occ IS NOT NULL AND occOpen AND candScore > occScore
    UNION ALL SELECT entityId, evaluatedAt, CASE WHEN len(l) > 1 THEN 'CREATE_BATCH' ELSE 'CREATE' END, CASE WHEN len(l) = 1 THEN l[1] END, channel, CASE WHEN len(l) > 1 THEN array_to_string(l, ',') END FROM made"""))
def t4_route(spark, sf_dir):
    """All evaluations, with one action suppressed everywhere and one by email, and batches by email and push."""
    routed = rules.route(T.candidates(spark, sf_dir), BY, suppressed_actions(spark), MAX_BATCH)
    return routed.withColumn("actions", F.array_join("actions", ","))


def suppressed_actions(spark):
    """What operators suppressed: a setting that people make, not data."""
    return spark.createDataFrame([("action_4", None), ("action_7", "email")], "actionId string, channel string")


@query(T.oracle("candidates", """e AS (SELECT entityId, evaluatedAt, list_sort(list(actionId || '::' || channel || '::' || contentKey) FILTER (eligible)) AS sig,
        list_sort(list(actionId || channel || coalesce(score::VARCHAR, 'x') || coalesce(workflowState, 'x') || eligible || softCompleted || hardCompleted)) AS sigAll FROM candidates GROUP BY ALL),
    d AS (SELECT entityId, evaluatedAt, lead(evaluatedAt) OVER w AS nextAt, sig, lead(sig) OVER w AS nextSig, sigAll, lead(sigAll) OVER w AS nextAll FROM e WINDOW w AS (PARTITION BY entityId ORDER BY evaluatedAt))
    SELECT entityId, nextAt AS evaluatedAt, CASE WHEN sig IS DISTINCT FROM nextSig THEN 'eligibility' ELSE 'score' END AS type FROM d WHERE nextAt IS NOT NULL AND sigAll IS DISTINCT FROM nextAll
    UNION ALL SELECT entityId, min(evaluatedAt), 'eligibility' FROM e GROUP BY entityId"""))
def t2_evaluate_changed(spark, sf_dir):
    from pyspark.sql import Window

    signed = rules.evaluation_signatures(T.candidates(spark, sf_dir), BY)
    order = Window.partitionBy("entityId").orderBy("evaluatedAt")
    before = signed.select("entityId", F.lead("evaluatedAt").over(order).alias("evaluatedAt"), "fullSig", "eligSig").where("evaluatedAt is not null")
    return rules.evaluate_changed(signed, before, BY).select(*BY, "type")


@query(T.oracle("facts_events facts_profile states", MEMBERS + """ SELECT entityId FROM g WHERE purchase > 10 AND entityId NOT IN (SELECT entityId FROM states WHERE state = 'HARD_COMPLETED' AND actionId = 'action_1')"""))
def t3_detect_latches(spark, sf_dir):
    from tidemark.functions.conditions import tree_to_column

    passing = members(spark, sf_dir).where(tree_to_column(F.col("facts"), PURCHASES)).select("entityId")
    return rules.detect_latches(passing, T.states(spark, sf_dir).where("state = 'HARD_COMPLETED' and actionId = 'action_1'"), ["entityId"])


@query(T.oracle("fact_history", "SELECT key, count(*) AS n FROM fact_history WHERE key IN ('operator.activity.error', 'operator.activity.signup', 'operator.activity.view', 'operator.profile.segment') GROUP BY key"))
def p17_facts_used(spark, sf_dir):
    used = facts_used(DEFS["actions"][1])
    return T.fact_history(spark, sf_dir).where(F.col("key").isin(used)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(T.oracle("touches", f"""SELECT channel, count(*) AS level, CASE channel WHEN 'email' THEN 50 WHEN 'sms' THEN 20 END AS rateCap, CASE channel WHEN 'email' THEN 401 END AS dailyCap FROM touches WHERE ts >= {T.NOW_MS - 30 * T.DAY_MS} GROUP BY channel"""))
def a12_throttle_caps(spark, sf_dir):
    caps = rules.throttle_caps(DEFS)
    cap = lambda m: F.coalesce(F.lit(None).cast("int"), *[F.when(F.col("channel") == c, F.lit(v[m])) for c, v in caps.items() if m in v])
    level = T.touches(spark, sf_dir).where(F.col("ts") >= T.NOW_MS - 30 * T.DAY_MS).groupBy("channel").agg(F.count(F.lit(1)).alias("level"))
    return level.select("channel", "level", cap("rate").alias("rateCap"), cap("daily").alias("dailyCap"))


