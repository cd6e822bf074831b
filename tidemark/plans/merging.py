"""Queries: how tables of the lake are written, and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import merging
from tidemark.plans.register import Register
from tidemark.sources import tables as T

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql

HALF = "eventTs < 1705363200000"
KEYS = ["entityType", "entityId", "key"]


def _halves(spark, sf_dir):
    """The gold table after the first half of the activity, and the facts of the second half."""
    f = T.facts_events(spark, sf_dir)
    return merging.latest_per_key(f.where(HALF), KEYS, "eventTs", ["value"]), f.where(f"not {HALF}")


@query(T.oracle("states", "SELECT entityId, actionId, channel, state, min(stTs) AS stTs, count(*) AS n FROM states GROUP BY ALL"))
def s09_append_dedup(spark, sf_dir):
    s = T.states(spark, sf_dir)
    counts = s.groupBy("entityId", "actionId", "channel", "state").agg(F.count(F.lit(1)).alias("n"))
    first = merging.append_dedup(s.select("entityId", "actionId", "channel", "state", "stTs"), ["entityId", "actionId", "channel", "state"])
    return first.join(counts, ["entityId", "actionId", "channel", "state"])


@query(T.oracle("states", """done AS (SELECT entityId, min(stTs) AS completedAt FROM states WHERE state = 'HARD_COMPLETED' AND actionId < 'action_5' GROUP BY entityId),
    late AS (SELECT entityId, min(stTs) AS completedAt FROM states WHERE state = 'HARD_COMPLETED' GROUP BY entityId)
    SELECT entityId, completedAt FROM done UNION ALL SELECT entityId, completedAt FROM late WHERE entityId NOT IN (SELECT entityId FROM done)"""))
def s10_w12_first_milestones(spark, sf_dir):
    s = T.states(spark, sf_dir).where("state = 'HARD_COMPLETED'")
    first = lambda d: d.groupBy("entityId").agg(F.min("stTs").alias("completedAt"))
    return merging.merge_insert_only(first(s.where("actionId < 'action_5'")), first(s), ["entityId"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS name FROM customer")
def s11_merge_all(spark, sf_dir):
    c = T.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return merging.merge_all(c, c.where("c_custkey % 3 = 0").withColumn("name", F.upper("name")), ["c_custkey"])


@query("""SELECT 'op-' || c_custkey AS entityId, CASE WHEN c_custkey % 5 = 0 THEN 'moved-' || c_custkey ELSE 'nba_' || c_custkey END AS nbaId,
    CASE WHEN c_custkey % 5 = 0 OR c_custkey % 4 = 1 THEN 2 ELSE 1 END AS updatedTs FROM customer""")
def s12_merge_if_changed(spark, sf_dir):
    c = T.read(spark, sf_dir, "customer").select("c_custkey", T.entity(F.col("c_custkey")).alias("entityId"), F.concat(F.lit("nba_"), F.col("c_custkey").cast("string")).alias("nbaId"))
    table = c.where("c_custkey % 4 <> 1 or c_custkey % 5 = 0").select("entityId", "nbaId", F.lit(1).alias("updatedTs"))
    incoming = c.where("c_custkey % 2 = 1 or c_custkey % 5 = 0").select("entityId", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("moved-"), F.col("c_custkey").cast("string"))).otherwise(F.col("nbaId")).alias("nbaId"), F.lit(2).alias("updatedTs"))
    return merging.merge_if_changed(table, incoming, ["entityId"], "nbaId", "updatedTs")


@query(T.oracle("facts_events", "SELECT entityType, entityId, key, arg_max(value, (eventTs, value)) AS value, any_value(valueType) AS valueType, max(eventTs) AS eventTs, any_value(source) AS source FROM facts_events GROUP BY entityType, entityId, key"))
def s13_merge_lww(spark, sf_dir):
    gold, late = _halves(spark, sf_dir)
    return merging.merge_lww(gold, merging.latest_per_key(late, KEYS, "eventTs", ["value"]), KEYS)


@query(T.oracle("facts_events", "SELECT eventTs, entityId, key, value FROM facts_events ORDER BY eventTs DESC, entityId DESC, key DESC, value DESC LIMIT 1"))
def s14_k4_latest_row(spark, sf_dir):
    latest, _ = merging.latest_and_history(T.facts_events(spark, sf_dir).select("eventTs", "entityId", "key", "value"), "eventTs")
    return latest


@query(T.oracle("facts_events", f"""old AS (SELECT entityId, key, arg_max(value, (eventTs, value)) AS value FROM facts_events WHERE {HALF} GROUP BY ALL),
    cur AS (SELECT entityId, key, arg_max(value, (eventTs, value)) AS value, max(eventTs) AS eventTs FROM facts_events GROUP BY entityId, key)
    SELECT c.* FROM cur c LEFT JOIN old o USING (entityId, key) WHERE o.entityId IS NULL OR o.value IS DISTINCT FROM c.value"""))
def s15_s16_changed_only(spark, sf_dir):
    gold, late = _halves(spark, sf_dir)
    now = merging.merge_lww(gold, late, KEYS)
    return merging.read_changes(gold, now, KEYS).select("entityId", "key", "value", "eventTs")


@query(T.oracle("facts_profile", """SELECT 'op-' || c_custkey AS entityId, f.k AS key, f.v AS value FROM (SELECT c_custkey, unnest([{'k': 'operator.profile.name', 'v': c_name},
    {'k': 'operator.profile.balance', 'v': (c_acctbal + 1)::VARCHAR}]) AS f FROM customer)"""))
def s18_medallion(spark, sf_dir):
    c = T.read(spark, sf_dir, "customer").select(T.entity(F.col("c_custkey")).alias("entityId"), "c_name", "c_acctbal")
    bronze = c.withColumn("eventTs", F.lit(1)).unionByName(c.withColumn("eventTs", F.lit(2)).withColumn("c_acctbal", F.col("c_acctbal") + 1))
    _, _, gold = merging.medallion(bronze.unionByName(bronze), ["entityId"], [("c_name", "operator.profile.name", "STRING"), ("c_acctbal", "operator.profile.balance", "DOUBLE")])
    return gold.select("entityId", "key", "value")


@query(T.oracle("facts_profile", """SELECT entityId AS entityid, '{' || string_agg('"' || key || '":"' || value || '"', ',' ORDER BY key) || '}' AS factmap FROM facts_profile GROUP BY entityId"""))
def s19_export_columns(spark, sf_dir):
    from tidemark.operators.ingest import member_fact_map

    return merging.export_columns(member_fact_map(T.facts_profile(spark, sf_dir)).withColumnRenamed("facts", "factMap"))


@query("SELECT ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 7 AS chunk, count(*) AS n FROM events GROUP BY ALL")
def s20_chunks(spark, sf_dir):
    return merging.with_chunk_id(T.read(spark, sf_dir, "events"), "event_id", 7).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


@query(T.oracle("touches", "SELECT entityId, channel, count(*) AS n FROM touches GROUP BY ALL UNION ALL SELECT entityId, 'total', count(*) FROM touches GROUP BY ALL"))
def u1_union_counts(spark, sf_dir):
    per = T.touches(spark, sf_dir).groupBy("entityId", "channel").agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("entityId").agg(F.sum("n").alias("n")).withColumn("channel", F.lit("total"))
    return per.unionByName(total)


@query(T.oracle("touches sends", "SELECT 'touch' AS kind, entityId, channel, ts FROM touches UNION ALL SELECT 'send', entityId, channel, decisionTs FROM sends"))
def u2_u3_union_feed(spark, sf_dir):
    touch = T.touches(spark, sf_dir).select(F.lit("touch").alias("kind"), "entityId", "channel", "ts")
    return touch.unionByName(T.sends(spark, sf_dir).select(F.lit("send").alias("kind"), "entityId", "channel", F.col("decisionTs").alias("ts")))


@query(T.oracle("fact_history", f"""SELECT 'added' AS change, key FROM (SELECT key FROM fact_history EXCEPT SELECT key FROM fact_history WHERE {HALF} OR key LIKE 'nba.score.action_1%')
    UNION ALL SELECT 'removed', key FROM (SELECT key FROM fact_history EXCEPT SELECT key FROM fact_history WHERE key NOT LIKE 'operator.profile.%')"""))
def u4_fact_set_diff(spark, sf_dir):
    keys = T.fact_history(spark, sf_dir)
    known = keys.where(f"{HALF} or key like 'nba.score.action_1%'").select("key").distinct()
    current = keys.where("key not like 'operator.profile.%'").select("key").distinct()
    all_keys = keys.select("key").distinct()
    return all_keys.subtract(known).select(F.lit("added").alias("change"), "key").unionByName(all_keys.subtract(current).select(F.lit("removed").alias("change"), "key"))


@query(T.oracle("touches", "SELECT DISTINCT entityId, actionId, channel FROM touches"))
def u6_distinct_sends(spark, sf_dir):
    return T.touches(spark, sf_dir).select("entityId", "actionId", "channel").distinct()
