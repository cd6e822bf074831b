"""Queries: decoding, quarantine, normalisation, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import ingest
from tidemark.plans.register import Register
from tidemark.sources import tables as T

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql


def _payloads(spark, sf_dir):
    c = T.read(spark, sf_dir, "conversations")
    good = F.to_json(F.struct("role", "turn"))
    return c.select(F.lit("chat").alias("topic"), (F.col("conv_id") % 8).alias("partition"), (F.col("conv_id") * 100 + F.col("turn")).alias("offset"), F.col("conv_id").cast("string").alias("key"), F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.col("text")).otherwise(good).alias("value"), F.lit(None).cast("map<string,string>").alias("headers"))


@query("SELECT conv_id % 8 AS partition, conv_id * 100 + turn AS \"offset\", role, turn FROM conversations WHERE (conv_id + turn) % 7 <> 0")
def s04_decoded(spark, sf_dir):
    good, _ = ingest.split_malformed(_payloads(spark, sf_dir), "value", "role STRING, turn LONG")
    return good.select("partition", "offset", "data.role", "data.turn")


@query(f"SELECT 'chat-reader' AS consumer, 'chat' AS topic, conv_id % 8 AS partition, conv_id * 100 + turn AS \"offset\", conv_id::VARCHAR AS key, text AS value, 'not a JSON object' AS error, {T.NOW_MS}::BIGINT AS dlqTs FROM conversations WHERE (conv_id + turn) % 7 = 0")
def s05_quarantine(spark, sf_dir):
    _, bad = ingest.split_malformed(_payloads(spark, sf_dir), "value", "role STRING, turn LONG")
    return ingest.to_dlq(bad, "chat-reader", T.NOW_MS).drop("headers")


@query("SELECT 'chat' AS topic, conv_id % 8 AS partition, conv_id * 100 + turn AS \"offset\", conv_id::VARCHAR AS key, text AS value FROM conversations WHERE (conv_id + turn) % 7 = 0 AND conv_id % 3 <> 0")
def s06_replay(spark, sf_dir):
    _, bad = ingest.split_malformed(_payloads(spark, sf_dir), "value", "role STRING, turn LONG")
    dlq = ingest.to_dlq(bad, "chat-reader", T.NOW_MS)
    return ingest.replay_dlq(dlq, "chat-reader", dlq.where("cast(key as long) % 3 = 0")).drop("headers")


@query(T.oracle("facts_profile", """SELECT entityId, key, CASE WHEN valueType IN ('DOUBLE', 'BOOLEAN') THEN value ELSE '"' || value || '"' END AS json FROM facts_profile"""))
def s08_fact_json(spark, sf_dir):
    f = T.facts_profile(spark, sf_dir)
    return f.select("entityId", "key", ingest.fact_to_json(F.col("value"), F.col("valueType")).alias("json"))


@query(T.oracle("touches", "SELECT touchId, entityId FROM touches WHERE touchId % 3 <> 0 AND touchId % 5 <> 1"))
def p01_p02_loop_guards(spark, sf_dir):
    header = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))
    t = T.touches(spark, sf_dir)
    headers = F.array_compact(F.array(F.when(F.col("touchId") % 3 == 0, header("origin", "lake")), F.when(F.col("touchId") % 5 == 1, header("type", "score"))))
    return ingest.drop_score_evals(ingest.drop_origin(t.withColumn("headers", headers))).select("touchId", "entityId")


@query(T.oracle("fact_history", "SELECT entityId || ':' || split_part(key, '.', 3) || ':' || split_part(key, '.', 4) AS lifecycleId, value, eventTs FROM fact_history WHERE key LIKE 'nba.disposition.%'"))
def p03_state_events(spark, sf_dir):
    f = ingest.with_fact_dims(T.fact_history(spark, sf_dir).where(F.col("key").startswith("nba.disposition.")))
    return f.select(F.concat_ws(":", "entityId", "actionId", "channel").alias("lifecycleId"), "value", "eventTs")


@query(T.oracle("fact_history", """SELECT entityId, key, CASE WHEN key LIKE 'comms.sent.%' THEN 'sent' ELSE value END AS value, eventTs,
    CASE WHEN key LIKE 'operator.%' THEN split_part(key, '.', 2) WHEN key LIKE 'nba.%' THEN split_part(key, '.', 2) ELSE 'disposition' END AS factClass,
    CASE WHEN key LIKE 'nba.%' THEN split_part(key, '.', 3) WHEN key LIKE 'comms.sent.%' THEN 'external' END AS actionId,
    CASE WHEN key LIKE 'nba.%' THEN split_part(key, '.', 4) WHEN key LIKE 'comms.sent.%' THEN split_part(key, '.', 3) END AS channel FROM fact_history"""))
def p04_p05_fact_dims(spark, sf_dir):
    return ingest.with_fact_dims(T.fact_history(spark, sf_dir)).select("entityId", "key", "value", "eventTs", "factClass", "actionId", "channel")


def _raw(spark, sf_dir):
    c = T.read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    crm = c.select(F.to_json(F.struct(T.entity(key).alias("contactId"), F.lit(T.PROFILE_MS).alias("ts"), F.lit("CRM-export").alias("source"), F.struct((key % 33 == 0).alias("is_dnc"), (key % 7 != 0).alias("sms-consent"), (key % 90).alias("days_since_login"), F.col("c_mktsegment").alias("market_segment_name")).alias("fields"))).alias("payload"))
    o = T.read(spark, sf_dir, "orders")
    billing = o.select(F.to_json(F.struct(T.entity(F.col("o_custkey")).alias("account"), T.millis(F.col("o_orderdate")).alias("ts"), F.lit("billing").alias("system"), F.col("o_orderkey").alias("mrr"), F.col("o_orderstatus").alias("status"))).alias("payload"))
    e = T.read(spark, sf_dir, "events")
    product = e.select(F.to_json(F.struct(T.entity(F.col("user_id")).alias("user"), T.millis(F.col("ts")).alias("timestamp"), F.lit("product-app").alias("_src"), F.col("event_type").alias("event"), F.struct((F.col("event_id") % 9).alias("page_depth")).alias("props"))).alias("payload"))
    li = T.read(spark, sf_dir, "lineitem")
    support = li.select(F.to_json(F.struct(F.lit("support").alias("source"), F.struct(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("account"), F.col("l_linenumber").alias("csat"), F.when(F.col("l_returnflag") == "R", "high").alias("priority")).alias("ticket"))).alias("payload"))
    unknown = e.select(F.to_json(F.struct(F.col("event_id").alias("blip"))).alias("payload"))
    sup = T.read(spark, sf_dir, "supplier")
    own = sup.select(F.to_json(F.struct(F.lit("MEMBER").alias("entityType"), F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string")).alias("entityId"), F.lit("profile.nation").alias("key"), F.col("s_nationkey").cast("string").alias("value"), F.lit("STRING").alias("valueType"), F.lit(T.PROFILE_MS).alias("ts"))).alias("payload"))
    untyped = sup.select(F.to_json(F.struct(F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string")).alias("entityId"), F.lit("profile.key").alias("key"), F.col("s_suppkey").alias("value"), F.lit("Registry").alias("source"))).alias("payload"))
    no_ticket = sup.select(F.to_json(F.struct(F.lit("support").alias("source"), F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string")).alias("accountId"), F.col("s_nationkey").alias("csat"), F.lit("").alias("event"))).alias("payload"))
    no_contact = sup.select(F.to_json(F.struct(F.lit("").alias("contactId"), F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string")).alias("contact_id"), F.lit("crm").alias("source"), F.struct((F.col("s_suppkey") % 2 == 0).alias("used_chat")).alias("attributes"))).alias("payload"))
    for more in (billing, product, support, unknown, own, untyped, no_ticket, no_contact):
        crm = crm.unionByName(more)
    return crm


@query(f"""WITH f AS (
    SELECT 'op-' || c_custkey AS entityId, unnest([
        {{'k': 'operator.profile.isDNC', 'v': (c_custkey % 33 = 0)::VARCHAR, 't': 'BOOLEAN'}}, {{'k': 'operator.profile.smsConsent', 'v': (c_custkey % 7 <> 0)::VARCHAR, 't': 'BOOLEAN'}},
        {{'k': 'operator.activity.daysSinceLogin', 'v': (c_custkey % 90)::VARCHAR, 't': 'LONG'}}, {{'k': 'operator.activity.marketSegmentName', 'v': c_mktsegment, 't': 'STRING'}}]) AS f, {T.PROFILE_MS}::BIGINT AS eventTs, 'lake:crm-export' AS source FROM customer
    UNION ALL SELECT 'op-' || o_custkey, unnest([{{'k': 'operator.mrr', 'v': o_orderkey::VARCHAR, 't': 'LONG'}}, {{'k': 'operator.status', 'v': o_orderstatus, 't': 'STRING'}}]), epoch_us(o_orderdate) // 1000, 'lake:billing' FROM orders
    UNION ALL SELECT 'op-' || user_id, unnest([{{'k': 'operator.lastEvent', 'v': event_type, 't': 'STRING'}}, {{'k': 'operator.pageDepth', 'v': (event_id % 9)::VARCHAR, 't': 'LONG'}}]), epoch_us(ts) // 1000, 'lake:product-app' FROM events
    UNION ALL SELECT 'order-' || l_orderkey, unnest([{{'k': 'operator.csat', 'v': l_linenumber::VARCHAR, 't': 'LONG'}}, {{'k': 'operator.priority', 'v': CASE WHEN l_returnflag = 'R' THEN 'high' END, 't': 'STRING'}}]), {T.NOW_MS}::BIGINT, 'lake:support' FROM lineitem
    UNION ALL SELECT 'sup-' || s_suppkey, unnest([{{'k': 'profile.key', 'v': s_suppkey::VARCHAR, 't': 'LONG'}}]), {T.NOW_MS}::BIGINT, 'lake:registry' FROM supplier
    UNION ALL SELECT 'sup-' || s_suppkey, unnest([{{'k': 'operator.csat', 'v': s_nationkey::VARCHAR, 't': 'LONG'}}]), {T.NOW_MS}::BIGINT, 'lake:support' FROM supplier
    UNION ALL SELECT 'sup-' || s_suppkey, unnest([{{'k': 'operator.activity.usedChat', 'v': (s_suppkey % 2 = 0)::VARCHAR, 't': 'BOOLEAN'}}]), {T.NOW_MS}::BIGINT, 'lake:crm' FROM supplier)
    SELECT 'MEMBER' AS entityType, 'sup-' || s_suppkey AS entityId, 'profile.nation' AS key, s_nationkey::VARCHAR AS value, 'STRING' AS valueType, {T.PROFILE_MS}::BIGINT AS eventTs, 'lake:unknown' AS source FROM supplier
    UNION ALL SELECT 'OPERATOR' AS entityType, entityId, f.k AS key, f.v AS value, f.t AS valueType, eventTs, source FROM f WHERE f.v IS NOT NULL""")
def p06_normalize_inbound(spark, sf_dir):
    return ingest.normalize_inbound(_raw(spark, sf_dir), default_ts=T.NOW_MS)


@query("""SELECT c_custkey, f.k AS key, f.v AS value, f.t AS valueType FROM (SELECT c_custkey, unnest([{'k': 'operator.profile.name', 'v': c_name, 't': 'STRING'},
    {'k': 'operator.profile.nation', 'v': c_nationkey::VARCHAR, 't': 'LONG'}]) AS f FROM customer) WHERE f.v IS NOT NULL""")
def p07_melt_facts(spark, sf_dir):
    return ingest.melt_facts(T.read(spark, sf_dir, "customer"), ["c_custkey"], [("c_name", "operator.profile.name", "STRING"), ("c_nationkey", "operator.profile.nation", "LONG")])


FEATURES = {"isDNC": ("operator.profile.isDNC", "bool"), "smsConsent": ("operator.profile.smsConsent", "bool"), "balance": ("operator.profile.balance", "num"), "segment": ("operator.profile.segment", "num")}


@query(T.oracle("facts_profile", """SELECT entityId, max(CASE WHEN key = 'operator.profile.isDNC' AND value = 'true' THEN 1.0 ELSE 0.0 END)::DOUBLE AS isDNC,
    max(CASE WHEN key = 'operator.profile.smsConsent' AND value = 'true' THEN 1.0 ELSE 0.0 END)::DOUBLE AS smsConsent,
    max(CASE WHEN key = 'operator.profile.balance' THEN value::DOUBLE END) AS balance, 0.0::DOUBLE AS segment FROM facts_profile GROUP BY entityId"""))
def p08_p10_pivot_features(spark, sf_dir):
    return ingest.pivot_features(T.facts_profile(spark, sf_dir), "entityId", FEATURES)


@query(T.oracle("fact_history", """latest AS (SELECT entityId, key, arg_max(value, (eventTs, value)) AS value FROM fact_history GROUP BY ALL)
    SELECT entityId, count(*) AS n_facts, string_agg(key || '=' || value, ';' ORDER BY key) AS facts FROM latest GROUP BY entityId"""))
def p09_member_fact_map(spark, sf_dir):
    m = ingest.member_fact_map(T.fact_history(spark, sf_dir))
    shown = F.array_join(F.transform(F.map_entries("facts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return m.select("entityId", F.size("facts").cast("long").alias("n_facts"), shown.alias("facts"))


@query(T.oracle("fact_history", "SELECT key, count(*) AS n FROM fact_history WHERE key IN ('operator.activity.purchase', 'operator.profile.isDNC') OR key LIKE 'nba.%' GROUP BY key"))
def p11_lean_filter(spark, sf_dir):
    history = T.fact_history(spark, sf_dir)
    used = history.where("key in ('operator.activity.purchase', 'operator.profile.isDNC')").select("key")
    return ingest.lean_filter(history, used).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT *, CASE event_id % 6 WHEN 0 THEN 'nba.throttle.email.rate' WHEN 1 THEN 'nba.actionsuppress.action_1' ELSE 'nba.score.action_1.email' END AS key,
        CASE event_id % 4 WHEN 0 THEN 'saturated' WHEN 1 THEN 'router' WHEN 2 THEN 'score' END AS kind FROM events)
    SELECT event_id, 'definitions' AS route FROM f WHERE event_id % 6 < 2 UNION ALL SELECT event_id, 'hot' FROM f WHERE event_id % 6 = 0 AND kind = 'saturated'
    UNION ALL SELECT event_id, 'firehose' FROM f WHERE event_id % 6 >= 2 AND kind IS NOT NULL UNION ALL SELECT event_id, 'snapshot' FROM f WHERE event_id % 6 >= 2 AND kind IS DISTINCT FROM 'router'""")
def p12_classify_routes(spark, sf_dir):
    e = T.read(spark, sf_dir, "events").select("event_id")
    key = F.when(F.col("event_id") % 6 == 0, "nba.throttle.email.rate").when(F.col("event_id") % 6 == 1, "nba.actionsuppress.action_1").otherwise("nba.score.action_1.email")
    kind = F.when(F.col("event_id") % 4 == 0, "saturated").when(F.col("event_id") % 4 == 1, "router").when(F.col("event_id") % 4 == 2, "score")
    return ingest.classify(e.withColumns({"key": key, "kind": kind})).select("event_id", "route")


@query("SELECT event_id, value AS score FROM events")
def p13_flatten_score(spark, sf_dir):
    e = T.read(spark, sf_dir, "events")
    mixed = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("value").alias("score")))).otherwise(F.col("value").cast("string"))
    return e.select("event_id", ingest.flatten_score(mixed).alias("score"))


@query(T.oracle("candidates", "SELECT entityId, evaluatedAt, actionId, channel, score FROM candidates WHERE eligible"))
def p14_explode_evaluations(spark, sf_dir):
    cols = ["actionId", "channel", "score", "eligible"]
    evals = T.candidates(spark, sf_dir).groupBy("entityId", "evaluatedAt").agg(F.collect_list(F.struct(*cols)).alias("channelActions"))
    return evals.select("entityId", "evaluatedAt", F.explode("channelActions").alias("a")).select("entityId", "evaluatedAt", "a.*").where("eligible").drop("eligible")


@query(T.oracle("candidates", "SELECT entityId, evaluatedAt, op, actionId, channel, contentKey AS name, score FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY entityId, evaluatedAt) > 1 THEN 'CREATE_BATCH' ELSE 'CREATE' END AS op FROM candidates)"))
def p15_explode_activations(spark, sf_dir):
    item = F.struct("actionId", "channel", F.col("contentKey").alias("name"), "score")
    acts = T.candidates(spark, sf_dir).groupBy("entityId", "evaluatedAt").agg(F.collect_list(item).alias("actions"))
    single = F.size("actions") == 1
    acts = acts.select("entityId", "evaluatedAt", F.when(single, "CREATE").otherwise("CREATE_BATCH").alias("op"), F.when(~single, F.col("actions")).alias("actions"), *(F.when(single, F.col("actions")[0][c]).alias(c) for c in ("actionId", "channel", "name", "score")))
    return ingest.explode_activation(acts)


def _definitions(spark, sf_dir):
    """Definition documents made from the contact history: an action's channels, and a gate on the members' activity."""
    t = T.touches(spark, sf_dir).groupBy("actionId").agg(F.array_sort(F.collect_set("channel")).alias("channels"), F.max("ts").alias("updatedTs"))
    n = F.substring_index("actionId", "_", -1).cast("int")
    leaf = F.struct(F.when(n % 2 == 0, "operator.activity.purchase").otherwise("operator.activity.view").alias("fact"), F.lit("gt").alias("cmp"), (n * 10).alias("value"))
    dnc = F.struct(F.lit("operator.profile.isDNC").alias("fact"), F.lit("eq").alias("cmp"), F.lit(0).alias("value"))
    doc = F.struct(F.col("actionId").alias("id"), F.concat(F.lit("Action "), n.cast("string")).alias("name"), (n * 60).alias("ttlSeconds"), F.transform("channels", lambda c: F.struct(c.alias("channel"))).alias("channels"), F.struct(F.lit("all").alias("op"), F.array(leaf, dnc).alias("conditions")).alias("inclusion"))
    return t.select(F.concat(F.lit("ACTION:"), "actionId").alias("key"), F.to_json(doc).alias("value"), "updatedTs")


@query(T.oracle("touches", """SELECT actionId AS id, 'ACTION' AS defType, 'Action ' || substr(actionId, 8) AS name, substr(actionId, 8)::BIGINT * 60 AS ttlSeconds,
    CASE WHEN substr(actionId, 8)::INT % 2 = 0 THEN 'operator.activity.purchase' ELSE 'operator.activity.view' END || ',operator.profile.isDNC' AS factsUsed, max(ts) AS updatedTs FROM touches GROUP BY actionId"""))
def p16_p17_definitions(spark, sf_dir):
    dim = ingest.parse_definition(_definitions(spark, sf_dir))
    return dim.select("id", "defType", "name", "ttlSeconds", F.array_join("factsUsed", ",").alias("factsUsed"), "updatedTs")


@query(T.oracle("touches facts_events", """SELECT a.actionId, f.key, f.n FROM (SELECT DISTINCT actionId, CASE WHEN substr(actionId, 8)::INT % 2 = 0 THEN 'operator.activity.purchase' ELSE 'operator.activity.view' END AS key FROM touches) a
    JOIN (SELECT key, count(*) AS n FROM facts_events GROUP BY key) f ON f.key = a.key"""))
def p19_action_fact_map(spark, sf_dir):
    edges = ingest.action_fact_map(ingest.parse_definition(_definitions(spark, sf_dir)))
    return edges.join(T.facts_events(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").select("actionId", "key", "n")


def _catalogue(spark, sf_dir):
    """The same actions with gates of one or two levels that ask for 0 to 8 completed tasks, a completion fact, and a few left over from tests."""
    t = T.touches(spark, sf_dir).groupBy("actionId").agg(F.array_sort(F.collect_set("channel")).alias("channels"), F.max("ts").alias("updatedTs"))
    n = F.substring_index("actionId", "_", -1).cast("int")
    leaf = lambda fact, value: F.struct(F.lit("gte").alias("cmp"), value.alias("value"), fact.alias("fact"))
    tasks, login = leaf(F.lit("operator.activity.completedTasks"), n % 9), leaf(F.lit("operator.activity.daysSinceLogin"), F.lit(1))
    inner = F.struct(F.lit("any").alias("op"), F.when(n % 4 > 0, F.array(tasks, login)).otherwise(F.array(login)).alias("conditions"))
    gate = F.to_json(F.struct(F.lit("all").alias("op"), F.array(inner).alias("conditions")))
    goal = F.to_json(F.array(leaf(F.concat(F.lit("operator.activity.goal"), n.cast("string")), F.lit(1)), login))
    channels = F.transform("channels", lambda c: F.struct(F.when(c != "voice", c).alias("channel"), F.concat(F.when(n == 5, "vtest-").otherwise("tmpl-"), c).alias("contentKey")))
    name = F.when(n == 8, "VariantTest").otherwise(F.concat(F.lit("Action "), n.cast("string")))
    text = F.format_string('{"id":"%s","name":"%s","channels":%s,"inclusion":%s,"logic":%s}', "actionId", name, F.to_json(channels), gate, goal)
    return t.select(F.concat(F.lit("ACTION:"), "actionId").alias("key"), text.alias("value"), "updatedTs")


@query(T.oracle("touches", """a AS (SELECT DISTINCT actionId, channel, substr(actionId, 8)::INT AS n FROM touches), k AS (SELECT * FROM a WHERE n NOT IN (5, 8) AND channel <> 'voice')
    SELECT actionId, channel, 'Action ' || n AS name, CASE WHEN n % 4 = 0 THEN 'activated' WHEN n % 9 >= 6 THEN 'upgraded' WHEN n % 9 >= 3 THEN 'engaged' ELSE 'onboarded' END AS "group", 'goal' || n AS drives, row_number() OVER (ORDER BY actionId, channel) - 1 AS arm FROM k"""))
def p20_arms(spark, sf_dir):
    return ingest.load_arms(ingest.parse_definition(_catalogue(spark, sf_dir)))


@query(T.oracle("touches", "SELECT touchId, CASE WHEN touchId % 4 <> 0 THEN entityId END AS nbaId, CASE WHEN touchId % 4 <> 0 THEN actionId END AS actionId, CASE WHEN touchId % 4 <> 0 THEN channel END AS channel FROM touches"))
def p21_parse_tracking(spark, sf_dir):
    t = T.touches(spark, sf_dir)
    tracking = F.concat(F.when(F.col("touchId") % 4 == 0, "x:").otherwise("nba-ca:"), F.concat_ws(":", "entityId", "actionId", "channel"), F.lit("|c-"), F.col("touchId").cast("string"))
    return t.select("touchId", *(c.alias(n) for n, c in ingest.parse_tracking(tracking).items()))


@query(T.oracle("dispositions", "SELECT correlationId, raw, CASE raw WHEN 'Unsubscribe' THEN 'DECLINED' ELSE 'PRESENTED' END AS state, count(*) AS n FROM dispositions GROUP BY ALL"))
def p22_disposition_states(spark, sf_dir):
    d = T.dispositions(spark, sf_dir)
    return d.select("correlationId", "raw", scalars.disposition_state(F.col("raw")).alias("state")).groupBy("correlationId", "raw", "state").agg(F.count(F.lit(1)).alias("n"))


@query(T.oracle("dispositions", "SELECT entityId, " + ", ".join(
    f"max((channel = '{c.rsplit('_', 1)[1]}' AND raw IN ({', '.join(repr(r) for r, n in ingest.ENGAGEMENT[c.rsplit('_', 1)[1]].items() if n == c.rsplit('_', 1)[0])}))::INT) AS {c}" for c in ingest.ENGAGEMENT_COLUMNS) + " FROM dispositions GROUP BY entityId"))
def p23_engagement_onehot(spark, sf_dir):
    return ingest.engagement_onehot(T.dispositions(spark, sf_dir), ["entityId"])


@query(T.oracle("facts_profile", f"""SELECT entityId, value || '!' AS shown, (('0x' || substr(md5(entityId || '|' || value), 1, 8))::BIGINT / 4294967295::DOUBLE) AS stable,
    'c_' || substr(sha256(entityId || '|' || value), 1, 16) AS id, value IN ('true', '1', 'completed') AS truthy,
    eventTs // 86400000 * 86400000 AS day, eventTs // 86400000 * 86400000 + 86400000 AS midnight,
    greatest(1, ceil((86400000 - eventTs % 86400000) / 300000.0))::BIGINT AS windows_left,
    round(1 / (1 + exp(-greatest(least(length(value)::DOUBLE, 30), -30))), 12) AS sigmoid FROM facts_profile WHERE key = 'operator.profile.segment'"""))
def f01_f22_scalars(spark, sf_dir):
    f = T.facts_profile(spark, sf_dir).where("key = 'operator.profile.segment'")
    value, ts = F.col("value"), F.col("eventTs")
    return f.select(
        "entityId", F.concat(value, F.lit("!")).alias("shown"), scalars.stable01(F.col("entityId"), value).alias("stable"), scalars.stable_id(F.col("entityId"), value).alias("id"),
        scalars.truthy(value).alias("truthy"), scalars.day_floor(ts).alias("day"), scalars.next_midnight(ts).alias("midnight"), scalars.windows_left(ts, 300).alias("windows_left"), F.round(scalars.sigmoid(F.length(value).cast("double")), 12).alias("sigmoid"),
    )
