"""Queries that run as streams: given tables are published as file topics, drained in micro-batches, and what comes out is the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.ingest import with_fact_dims
from tidemark.operators.merging import sink_name
from tidemark.plans.register import Register
from tidemark.plans.reports import NET
from tidemark.sources import streams
from tidemark.sources import tables as T
from tidemark.streaming import definitions, feedback, metrics, spine, topics

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql

NOW, DAY, WEEK, HOUR = T.NOW_MS, T.DAY_MS, 7 * T.DAY_MS, T.HOUR_MS
SINCE = {"daily": DAY, "weekly": WEEK}


def counters(spark, sf_dir, now_ms):
    """(tables, emitted rows with their batch) after all states of the fact history came in micro-batches."""
    facts = with_fact_dims(T.fact_history(spark, sf_dir)).where("factClass = 'actionstate'")
    topic = topics.publish(facts, "facts", ["entityId"], "eventTs")
    tables, out = spine.BatchTables(spark, topics.new_folder(spark, "lake")), topics.new_folder(spark, "counters")
    each = spine.process_facts(tables, streams.idempotent_batch(spark, out, streams.overwrite_parquet), now_ms, {k: now_ms - ms for k, ms in SINCE.items()}, WEEK)
    streams.run_available_now(streams.read_files(spark, topic.path, topic.schema, max_files=2), topics.new_folder(spark, "facts-checkpoint"), lambda df, i: each(df, i))
    return tables, spark.read.option("basePath", out).parquet(out)


def counters_sql(now_ms: int) -> str:
    level = lambda ms: NET.format(f" AND eventTs >= {now_ms - ms}")
    each = " UNION ALL ".join(f"SELECT 'channel' AS scope, channel AS id, '{k}' AS key, {level(ms)} AS n FROM a WHERE eventTs BETWEEN {now_ms - ms} AND {now_ms} GROUP BY channel" for k, ms in SINCE.items())
    mine = f"FROM a WHERE value = 'IN_PROCESS' AND eventTs > {now_ms - WEEK} AND eventTs <= {now_ms} GROUP BY ALL"
    return f"""a AS (SELECT DISTINCT entityId, split_part(key, '.', 4) AS channel, key, eventTs, value FROM fact_history WHERE key LIKE 'nba.actionstate.%')
    {each} UNION ALL SELECT 'member', entityId, 'operator.comms.' || channel || 'sThisWeek', count(*) {mine} UNION ALL SELECT 'member', entityId, 'operator.comms.totalThisWeek', count(*) {mine}"""


@query(T.oracle("fact_history", counters_sql(NOW)))
def t16_event_counters(spark, sf_dir):
    """What the batches emitted last for each channel and member that they touched."""
    emitted = counters(spark, sf_dir, NOW)[1]
    return emitted.groupBy("scope", "id", "key").agg(F.max_by("n", "batch").alias("n"))


LATER = NOW + 36 * HOUR


@query(T.oracle("fact_history", counters_sql(LATER)))
def t17_rollover(spark, sf_dir):
    """All counters a day and a half later, without new data, from the same buckets."""
    return spine.rollover(counters(spark, sf_dir, NOW)[0], LATER, {k: LATER - ms for k, ms in SINCE.items()}, WEEK)


def stages(spark, sf_dir):
    """entityId, node, id, ts: each touch passes the engine's components, with delays that its number decides."""
    t = T.touches(spark, sf_dir).select("entityId", F.col("touchId").alias("id"), "ts")
    n = F.col("id")
    snapshot = F.col("ts") + 5 + (n * 7919) % 400
    rules = snapshot + 20 + (n * 104729) % 3000
    router = rules + 100 + (n * 1299709) % 70000
    each = F.array(*[F.struct(F.lit(node).alias("node"), at.alias("ts")) for node, at in (("lake", F.col("ts")), ("snapshot", snapshot), ("rules", rules), ("router", router))])
    return t.select("entityId", "id", F.explode(each).alias("s")).select("entityId", "s.node", "id", "s.ts")


STAGES_SQL = """t AS (SELECT entityId, touchId AS id, ts, ts + 5 + (touchId * 7919) % 400 AS snap FROM touches), u AS (SELECT *, snap + 20 + (id * 104729) % 3000 AS rule FROM t),
    s AS (SELECT entityId, 'lake' AS node, id, ts FROM u UNION ALL SELECT entityId, 'snapshot', id, snap FROM u UNION ALL SELECT entityId, 'rules', id, rule FROM u UNION ALL SELECT entityId, 'router', id, rule + 100 + (id * 1299709) % 70000 FROM u)"""
EDGES = [("lake", "snapshot"), ("snapshot", "rules"), ("lake", "rules"), ("rules", "router")]


@query(T.oracle("touches", STAGES_SQL + f""", e AS (SELECT * FROM (VALUES {', '.join(map(str, EDGES))}) v(up, node)),
    h AS (SELECT up || '>' || node AS edge, id, ts, ts - max(upTs) AS ms FROM (SELECT e.up, s.node, s.id, s.ts, s.entityId, b.ts AS upTs FROM s JOIN e USING (node) JOIN s b ON b.entityId = s.entityId AND b.node = e.up AND b.ts <= s.ts AND b.ts > s.ts - 60000) GROUP BY up, node, id, ts, entityId),
    k AS (SELECT edge, ms, CASE WHEN ms < 64 THEN ms ELSE ms >> (length(bin(ms)) - 7) << (length(bin(ms)) - 7) END AS low, unnest([ts // {12 * HOUR}, ts // {12 * HOUR} - 1]) * {12 * HOUR} AS windowStart FROM h)
    SELECT windowStart, edge, count(*) AS n, avg(ms) AS mean, list_sort(list(low))[count(*) // 2 + 1] AS p50, list_sort(list(low))[least(count(*) - 1, floor(count(*) * 0.95::DOUBLE)::BIGINT) + 1] AS p95 FROM k GROUP BY ALL HAVING count(*) >= 3"""))
def t20_live_hops(spark, sf_dir):
    """Hop latencies of at most a minute in windows of a day, every 12 hours."""
    topic = topics.publish(stages(spark, sf_dir), "stages", ["entityId", "node"], idle_ms=3 * DAY)
    live = topic.stream(spark)
    samples = metrics.hop_samples(live, live, EDGES, 60_000, HOUR // 12)
    return topics.drain(metrics.hop_windows(samples, "24 hours", "12 hours"), "hops")


@query(T.oracle("touches", STAGES_SQL + f" SELECT ts // {6 * HOUR} * {6 * HOUR} AS windowStart, node, count(*) / 21600.0::DOUBLE AS perSecond FROM s GROUP BY ALL"))
def t20_live_throughput(spark, sf_dir):
    topic = topics.publish(stages(spark, sf_dir), "stages", ["node", "entityId"], idle_ms=DAY)
    return topics.drain(metrics.throughput(topic.stream(spark), "6 hours", 21_600), "throughput").where("node <> '0'")  # without the heartbeat


@query(T.oracle("states", """c AS (SELECT entityId, split_part(actionId, '_', 2)::INT % 5 AS step, min(stTs) AS ts FROM states WHERE state = 'HARD_COMPLETED' GROUP BY ALL),
    r AS (SELECT entityId, step, ts FROM c WHERE step = 0 UNION ALL SELECT c.entityId, c.step, greatest(c.ts, r.ts) FROM r JOIN c ON c.entityId = r.entityId AND c.step = r.step + 1)
    SELECT entityId, unnest(['milestone', 'score']) AS kind, step, ts FROM r""").replace("WITH ", "WITH RECURSIVE ", 1))
def u5_loop_back(spark, sf_dir):
    """Milestones that build on each other: each comes back as input and may bring about the next; scores come back too, and the guard drops them."""
    done = T.states(spark, sf_dir).where("state = 'HARD_COMPLETED'")
    events = done.select("entityId", F.lit("completion").alias("kind"), (F.split_part("actionId", F.lit("_"), F.lit(2)).cast("int") % 5).alias("step"), F.col("stTs").alias("ts"), F.lit(None).cast("array<struct<key string, value string>>").alias("headers"))
    live = topics.publish(events, "completions", ["entityId"])
    return feedback.run_to_fixed_point(spark, live, feedback.milestone_chain, "milestones").select("entityId", "kind", "step", "ts")


@query(T.oracle("touches", """d AS (SELECT actionId AS id, ts AS updatedTs, max(CASE WHEN touchId % 5 > 0 THEN 'v' || touchId END) AS name, arg_max(touchId % 1000, CASE WHEN touchId % 5 > 0 THEN 'v' || touchId ELSE '' END) AS ttlSeconds FROM touches WHERE touchId % 97 = 0 GROUP BY ALL)
    SELECT touchId, name, ttlSeconds FROM touches ASOF JOIN d ON actionId = id AND ts >= updatedTs WHERE name IS NOT NULL"""))
def j12_definitions_in_time(spark, sf_dir):
    """Touches with the definition of their action as it was at their time; some versions are tombstones."""
    t = T.touches(spark, sf_dir)
    changes = t.where("touchId % 97 = 0").select(F.col("actionId").alias("id"), F.col("ts").alias("updatedTs"), F.when(F.col("touchId") % 5 > 0, F.concat(F.lit("v"), F.col("touchId").cast("string"))).alias("name"), (F.col("touchId") % 1000).alias("ttlSeconds"))
    control, events = topics.publish(changes, "control", ["id"], "updatedTs"), topics.publish(t, "touches", ["entityId"])
    defined = definitions.DefinedEvents(spark, topics.new_folder(spark, "defined"))
    defined.drain_control(streams.read_files(spark, control.path, control.schema))
    return defined.drain_events(streams.read_files(spark, events.path, events.schema)).select("touchId", "name", "ttlSeconds")


@query(T.oracle("touches", "SELECT channel, count(*) AS n, sum(touchId)::BIGINT AS ids FROM touches GROUP BY channel"))
def s02_s03_t18_drain_loop(spark, sf_dir):
    """Drains from one checkpoint with failures in between, a full reset, and drains from the entry offset: every touch is there once."""
    topic = topics.publish(T.touches(spark, sf_dir), "touches", ["entityId"])
    out, checkpoint = topics.new_folder(spark, "drained"), topics.new_folder(spark, "drained-checkpoint")
    write, fail = streams.idempotent_batch(spark, out, streams.overwrite_parquet), {0, 2}

    def each(df, batch_id):
        write(df, batch_id)
        if batch_id in fail:  # after its output was written, before its offsets are
            fail.remove(batch_id)
            raise ConnectionError("the source cannot be reached")

    again = lambda: streams.read_files(spark, topic.path, topic.schema, max_files=1)
    streams.run_continuously(again, checkpoint, each, drains=3)
    streams.reset(spark, [], [out, checkpoint])
    fail |= {1}
    streams.run_continuously(again, checkpoint, each, drains=3)
    rows = spark.read.schema(topic.schema).option("recursiveFileLookup", "true").parquet(out)
    return rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum("touchId").alias("ids"))


@query(T.oracle("touches", "SELECT touchId, channel FROM touches"))
def t19_dedup_ingress(spark, sf_dir):
    """Touches of which a third arrive again within two days: each is there once, and only two days of ids are kept."""
    t = T.touches(spark, sf_dir)
    again = t.where("touchId % 3 = 0").withColumn("ts", F.col("ts") + F.col("touchId") % 5 * 9 * HOUR)
    topic = topics.publish(t.unionByName(again), "ingress", ["touchId"])
    rows = streams.read_files(spark, topic.path, topic.schema).withColumn("at", F.timestamp_millis("ts"))
    return topics.drain(streams.dedup_ingress(rows, ["touchId"], "at", f"{topic.delay_ms + 2 * DAY} milliseconds"), "deduped").select("touchId", "channel")


@query(T.oracle("fact_history", """f AS (SELECT CASE WHEN key LIKE 'nba.disposition.%' THEN 'nba.facts' WHEN key LIKE 'nba.%' THEN 'nba.member.facts' ELSE 'datalake.streaming-inbound' END || '_shadow' AS topic, key FROM fact_history)
    SELECT topic, count(*) AS n, count(DISTINCT key) AS keys FROM f GROUP BY topic"""))
def s07_s21_shadow_topics(spark, sf_dir):
    """A shadow run writes its facts beside the real topics; the file twin of the sink, read back by topic."""
    key = F.col("key")
    real = F.when(key.startswith("nba.disposition."), sink_name("nba.facts", True)).when(key.startswith("nba."), sink_name("nba.member.facts", True)).otherwise(sink_name("datalake.streaming-inbound", True))
    path = topics.new_folder(spark, "sinks")
    streams.write_topic_files(T.fact_history(spark, sf_dir).withColumn("topic", real), path)
    return spark.read.parquet(path).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"))
