"""Queries: keyed state as streams over file topics, and batch twins of the lifecycle and of the throttle gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.register import Register
from tidemark.sources import tables as T
from tidemark.plans.sequences import SIBLING_VERDICTS
from tidemark.streaming import gates, lifecycle, siblings, topics

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql


def contact_events(spark, sf_dir):
    """Creates from orders, provider statuses from line items, completions and suppressions by order status."""
    s = T.sends(spark, sf_dir).withColumnRenamed("decisionTs", "ts")
    creates = s.withColumn("op", F.lit("CREATE"))
    dispositions = T.dispositions(spark, sf_dir).withColumnRenamed("eventTs", "ts")
    signals = s.where("status <> 'O'").withColumn("kind", F.when(F.col("status") == "F", "HARD").otherwise("SUPPRESS")).withColumn("ts", F.col("ts") + F.when(F.col("status") == "F", T.DAY_MS).otherwise(30_000))
    return lifecycle.lifecycle_events(creates, dispositions, signals)


LIFE = lifecycle.Config()
GONE = "('FAILED', 'HARD_COMPLETED', 'EXPIRED', 'SUPPRESSED', 'DEBOUNCED', '')"


def _due(ts: str, source: str) -> str:
    """SQL: what timers have done by ``ts``, first the end of the debounce and then expiry, to the state (st, dl) of ``source``; o lists the transitions."""
    started = f"SELECT *, CASE WHEN w THEN 'IN_PROCESS' ELSE st END AS s1, CASE WHEN w THEN dl + {LIFE.ttl_ms} ELSE dl END AS d1, CASE WHEN w THEN [{{'ts': dl, 'state': 'IN_PROCESS', 'op': 'DISPATCH'}}] ELSE [] END AS o1 FROM (SELECT *, st = 'CREATED' AND dl <= {ts} AS w FROM ({source}))"
    return f"SELECT * EXCLUDE (st, dl, w, s1, d1, o1, x), CASE WHEN x THEN 'EXPIRED' ELSE s1 END AS st, CASE WHEN x THEN -1 ELSE d1 END AS dl, CASE WHEN x THEN o1 || [{{'ts': d1, 'state': 'EXPIRED', 'op': NULL}}] ELSE o1 END AS o FROM (SELECT *, s1 NOT IN {GONE} AND s1 <> 'CREATED' AND d1 BETWEEN 0 AND {ts} AS x FROM ({started}))"


MOVES = f"""CASE WHEN kind = 'CREATE' THEN CASE WHEN NOT live THEN 'CREATED' END WHEN NOT live THEN NULL WHEN kind = 'HARD' THEN 'HARD_COMPLETED'
    WHEN kind = 'SUPPRESS' THEN CASE WHEN st = 'CREATED' THEN 'SUPPRESSED' WHEN st <> 'SUPPRESSING' THEN 'SUPPRESSING' END
    WHEN st <> 'CREATED' AND cid = corr THEN CASE WHEN raw = 'Unsubscribe' AND st <> 'DECLINED' THEN 'DECLINED' WHEN raw <> 'Unsubscribe' AND st <> 'PRESENTED' THEN 'PRESENTED' END END"""


@query(T.oracle("sends dispositions", f"""v AS (SELECT entityId, actionId, channel, decisionTs AS ts, 0 AS seq, 'CREATE' AS kind, NULL AS raw, correlationId AS cid FROM sends UNION ALL SELECT entityId, actionId, channel, eventTs, 1, 'DISPOSITION', raw, correlationId FROM dispositions
        UNION ALL SELECT entityId, actionId, channel, decisionTs + CASE status WHEN 'F' THEN {T.DAY_MS} ELSE 30000 END, 2, CASE status WHEN 'F' THEN 'HARD' ELSE 'SUPPRESS' END, NULL, correlationId FROM sends WHERE status <> 'O'),
    e AS (SELECT *, row_number() OVER (PARTITION BY entityId, actionId, channel ORDER BY ts, seq, kind, raw NULLS FIRST, cid NULLS FIRST) AS place FROM v),
    g AS (SELECT DISTINCT entityId, actionId, channel, 0::BIGINT AS place, '' AS st, -1::BIGINT AS dl, '' AS corr, []::STRUCT(ts BIGINT, state VARCHAR, op VARCHAR)[] AS o FROM e
        UNION ALL SELECT entityId, actionId, channel, place, coalesce(mv, st), CASE WHEN mv = 'CREATED' THEN ts + {LIFE.debounce_ms} WHEN mv IN {GONE} THEN -1 ELSE dl END, CASE WHEN mv = 'CREATED' THEN cid ELSE corr END,
            CASE WHEN mv IS NULL THEN o ELSE o || [{{'ts': ts, 'state': mv, 'op': CASE mv WHEN 'SUPPRESSING' THEN 'CANCEL' END}}] END
        FROM (SELECT *, {MOVES} AS mv FROM (SELECT *, st NOT IN {GONE} AS live FROM ({_due('ts', "SELECT e.*, g.st, g.dl, g.corr FROM g JOIN e ON e.entityId = g.entityId AND e.actionId = g.actionId AND e.channel = g.channel AND e.place = g.place + 1")})))),
    z AS (SELECT entityId, actionId, channel, o FROM ({_due(str(T.NOW_MS), "SELECT * EXCLUDE (o) FROM g QUALIFY row_number() OVER (PARTITION BY entityId, actionId, channel ORDER BY place DESC) = 1")}))
    SELECT entityId, actionId, channel, t.ts, t.state, t.op FROM (SELECT entityId, actionId, channel, unnest(o) AS t FROM g UNION ALL SELECT entityId, actionId, channel, unnest(o) FROM z)""").replace("WITH ", "WITH RECURSIVE ", 1))
def t5_lifecycle(spark, sf_dir):
    return lifecycle.replay_lifecycle(contact_events(spark, sf_dir), T.NOW_MS)


@query(T.oracle("touches", f"""q AS (SELECT touchId, channel, touchId % 4 AS shard, ts, row_number() OVER (PARTITION BY channel, touchId % 4 ORDER BY ts, touchId) AS place, CASE channel WHEN 'email' THEN 5 ELSE 1 END AS share FROM touches WHERE channel IN ('email', 'sms')),
    g AS (SELECT DISTINCT channel, shard, 0::BIGINT AS place, NULL::BIGINT AS id, NULL::BIGINT AS ts, -{T.NOW_MS}::BIGINT AS start, 0 AS sent, 0 AS waiting, NULL::VARCHAR AS decision FROM q
        UNION ALL SELECT channel, shard, place, touchId, ts, CASE WHEN fresh THEN ts ELSE start END, n + (n < share)::INT, waiting + (n >= share AND waiting < share)::INT, CASE WHEN n < share THEN 'SEND' WHEN waiting < share THEN 'WAIT' ELSE 'SUPPRESS' END
        FROM (SELECT q.*, g.start, g.waiting, q.ts - g.start >= {T.DAY_MS} AS fresh, CASE WHEN q.ts - g.start >= {T.DAY_MS} THEN 0 ELSE g.sent END AS n FROM g JOIN q ON q.channel = g.channel AND q.shard = g.shard AND q.place = g.place + 1))
    SELECT id, channel, ts, decision FROM g WHERE id IS NOT NULL UNION ALL SELECT touchId, channel, ts, 'SEND' FROM touches WHERE channel NOT IN ('email', 'sms')""").replace("WITH ", "WITH RECURSIVE ", 1))
def t6_throttle(spark, sf_dir):
    t = T.touches(spark, sf_dir).select(F.col("touchId").alias("id"), "channel", (F.col("touchId") % 4).cast("int").alias("shard"), "ts", F.lit(0).cast("long").alias("lakeRate"))
    return gates.throttle(t, {"email": 20, "sms": 4}, T.DAY_MS, shards=4)


DEBOUNCE = siblings.Config(debounce_ms=59_999)
CONTEST = ["entityId", "evaluatedAt"]


def sibling_contests(spark, sf_dir):
    """Events of the members' contests: where each candidate of an evaluation is, and creates of those that wait to be sent."""
    c = T.candidates(spark, sf_dir).where("workflowState is not null").withColumn("ts", F.col("evaluatedAt"))
    creates, states = c.where("workflowState = 'CREATED'"), c.where("workflowState <> 'CREATED'").withColumnRenamed("workflowState", "state")
    return siblings.sibling_events(creates, states, CONTEST)


@query(SIBLING_VERDICTS)
def t8_stream_debounce(spark, sf_dir):
    """The stream's first verdict on each created candidate; losers have left the contest, who waits is judged again."""
    topic = topics.publish(sibling_contests(spark, sf_dir), "contests", CONTEST, idle_ms=T.DAY_MS)
    with topics.rocksdb(spark):
        found = topics.drain(siblings.stream_siblings(topic.stream(spark), CONTEST, DEBOUNCE), "verdicts")
    return found.where(F.col("ts") == F.col("evaluatedAt") + DEBOUNCE.debounce_ms).select(*CONTEST, "actionId", "channel", "verdict")


@query(SIBLING_VERDICTS.replace("SELECT c.entityId", ", v AS (SELECT c.entityId", 1) + f""")
    SELECT v.entityId || '-' || v.evaluatedAt AS entityId, actionId, channel, evaluatedAt + t.ms AS ts, t.state, t.op
    FROM v JOIN (VALUES (NULL, 0, 'CREATED', NULL), (true, {DEBOUNCE.debounce_ms}, 'DEBOUNCED', NULL), (false, {LIFE.debounce_ms}, 'IN_PROCESS', 'DISPATCH'), (false, {LIFE.debounce_ms + LIFE.ttl_ms}, 'EXPIRED', NULL)) t(lost, ms, state, op)
      ON t.lost IS NULL OR t.lost = (verdict = 'LOSE')
    WHERE evaluatedAt + t.ms <= {T.NOW_MS}""")
def t8_t5_debounced_lifecycle(spark, sf_dir):
    """Lifecycles of created candidates, one for each evaluation: the losers' signals end them before they are dispatched."""
    named = F.concat_ws("-", "entityId", F.col("evaluatedAt").cast("string"))
    lost = siblings.debounce_signals(siblings.replay_siblings(sibling_contests(spark, sf_dir), CONTEST, T.NOW_MS, DEBOUNCE).withColumn("entityId", named))
    creates = T.candidates(spark, sf_dir).where("workflowState = 'CREATED'").withColumn("entityId", named).withColumns({"ts": F.col("evaluatedAt"), "op": F.lit("CREATE")})
    none = creates.limit(0).withColumn("raw", F.lit(None).cast("string"))
    return lifecycle.replay_lifecycle(lifecycle.lifecycle_events(creates, none, lost), T.NOW_MS, LIFE)
