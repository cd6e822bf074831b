"""Micro-batches of the lake, live hop windows, definitions in time and the loop-back, against plain loops and recomputation."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import DAY_MS
from tidemark.operators import ingest, reports
from tidemark.sources import streams
from tidemark.streaming import definitions, feedback, metrics, spine, topics

NOW, WEEK = 20 * DAY_MS + 5_000, 7 * DAY_MS
SINCE = {"day": NOW - DAY_MS, "week": NOW - WEEK}
FACT = "entityType string, entityId string, key string, value string, valueType string, eventTs long, source string"


def history(seed=1, n=300):
    r = random.Random(seed)
    edges = [NOW - WEEK - 1, NOW - WEEK, NOW - WEEK + 1, NOW - DAY_MS, NOW, NOW + 1]
    rows = []
    for i in range(n):
        ts = r.choice([*edges, *[r.randrange(10 * DAY_MS, NOW + DAY_MS) for _ in range(6)]])
        value = r.choice(["IN_PROCESS"] * 3 + ["FAILED", "SUPPRESSED", "PRESENTED"])
        rows.append(("OPERATOR", r.choice(["m1", "m2", "m3", None]), f"nba.actionstate.a{i % 3}.{r.choice(['email', 'sms'])}", value, "STRING", ts, "x"))
    return [*rows, *rows[:40]]  # repeats that may come in other batches


def scratch(df, now, since, week):
    level = reports.net_sends(df, since, now)
    out = {("channel", r.channel, k, r[k]) for r in level.collect() for k in since}
    return out | {("member", r.entityId, r.key, r.n) for r in reports.comms_counts(df.where("factClass = 'actionstate'"), now, week, "IN_PROCESS").collect()}


@pytest.mark.parametrize("parts", [1, 4])
def test_counters_equal_recomputation_after_any_split(spark, tmp_path, parts):
    rows, tables, emitted = history(), spine.BatchTables(spark, f"file://{tmp_path}/t"), {}
    each = spine.process_facts(tables, lambda df, i: emitted.update({(r.scope, r.id, r.key): r.n for r in df.collect()}), NOW, SINCE, WEEK)
    for k in range(parts):
        batch = ingest.with_fact_dims(spark.createDataFrame(rows[k::parts], FACT))
        for _ in range(2):  # a retry changes nothing
            each(batch, k)
    whole = ingest.with_fact_dims(spark.createDataFrame(rows, FACT))
    assert {x for x in scratch(whole, NOW, SINCE, WEEK) if x[3]} == {(*k, n) for k, n in emitted.items() if n}
    for later in (NOW, NOW + 1, NOW + DAY_MS + 7, NOW + 3 * DAY_MS, NOW + 40 * DAY_MS):
        since = {"day": later - DAY_MS, "week": later - WEEK}
        rolled = {tuple(r) for r in spine.rollover(tables, later, since, WEEK).collect() if r.n}
        assert rolled == {x for x in scratch(whole, later, since, WEEK) if x[3]}


def test_micro_batches_give_the_gold_of_one_batch(spark, tmp_path):
    raw = [(json.dumps({"entityId": f"m{i % 3}", "key": "comms.sent.email", "value": i, "eventTs": i + 1} if i % 2 else {"contactId": f"m{i % 3}", "ts": i + 1, "fields": {"is_dnc": True, "riskScore": i}}),) for i in range(30)]
    made = {}
    for name, parts in (("a", 3), ("b", 1)):
        made[name] = spine.BatchTables(spark, f"file://{tmp_path}/{name}")
        each = spine.process_batch(made[name], lambda df, i: None, 100, {"all": 0}, WEEK)
        for k in range(parts):
            for _ in range(2):
                each(spark.createDataFrame(raw[k * 30 // parts : (k + 1) * 30 // parts], "payload string"), k)
    gold = [sorted(map(tuple, t.gold().select("entityId", "key", "value", "eventTs").collect())) for t in made.values()]
    latest = {}
    for r in made["b"].read("silver").orderBy("eventTs").collect():
        latest[r.entityId, r.key] = (r.entityId, r.key, r.value, r.eventTs)
    assert gold[0] == gold[1] == sorted(latest.values()) and len(gold[0]) == 9


def plain_hops(rows, edges, most):
    found = []
    for m, node, i, ts in rows:
        for up, to in edges:
            if to == node:
                before = [t for n, u, _, t in rows if (n, u) == (m, up) and ts - most < t <= ts]
                found += [(f"{up}>{node}", ts, ts - max(before))] if before else []
    return found


@pytest.mark.parametrize("steps", [1, 5])
def test_hop_windows_equal_a_plain_loop(spark, steps):
    r = random.Random(9)
    rows = [(f"m{r.randrange(4)}", r.choice(["a", "b", "c"]), i, 1_000_000 + r.randrange(400_000)) for i in range(160)]
    edges = [("a", "b"), ("b", "c"), ("a", "c")]
    df = spark.createDataFrame(rows, "entityId string, node string, id long, ts long")
    topic = topics.publish(df, "stages", ["entityId", "node"], steps=steps, idle_ms=500_000)
    got = topics.drain(metrics.hop_windows(metrics.hop_samples(topic.stream(spark), topic.stream(spark), edges, 20_000), "30 seconds", "10 seconds"), "hops").collect()
    windows = defaultdict(list)
    for edge, ts, ms in plain_hops(rows, edges, 20_000):
        for k in range(3):
            windows[(ts // 10_000 - k) * 10_000, edge].append(ms)
    def low(ms):
        cut = max(0, ms.bit_length() - 7)
        return ms >> cut << cut

    want = {(w, e, len(x), sum(x) / len(x), low(sorted(x)[len(x) // 2]), low(sorted(x)[min(len(x) - 1, int(len(x) * 0.95))])) for (w, e), x in windows.items() if len(x) >= 3}
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 20


def test_hops_of_one_stream_keep_a_set_for_each_entity_and_step(spark):
    """Samples of a dense and repeated history, across steps and arrivals, are those of a plain loop, each in its step; the only state is that of the sets."""
    r = random.Random(4)
    rows = [(f"m{r.randrange(3)}", r.choice(["a", "b", "c", "d"]), i, 1_000_000 + r.randrange(200_000)) for i in range(200)]
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")]
    df = spark.createDataFrame(rows + rows[:30], "entityId string, node string, id long, ts long")
    topic = topics.publish(df, "hops", ["entityId", "node"], steps=2, idle_ms=300_000)
    live, got = topic.stream(spark), []
    samples = metrics.hop_samples(live, live, edges, 20_000, 10_000).select("edge", F.unix_millis("at").alias("at"), "ms")
    query = streams.run_available_now(samples, topics.new_folder(spark, "hops-checkpoint"), lambda b, _: got.extend(map(tuple, b.collect())))
    want = [(edge, ts // 10_000, ms) for edge, ts, ms in plain_hops(rows, edges, 20_000)]
    assert sorted((e, at // 10_000, ms) for e, at, ms in got) == sorted(want) and len(want) > 100
    assert all(len(p.stateOperators) == 1 for p in query.recentProgress)
    keys = {(m, k) for m, _, _, ts in rows for k in range(ts // 10_000, ts // 10_000 + 3)}
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= len(keys) + 3


def test_sketches_merge_and_stay_within_a_sixty_fourth(spark):
    df = spark.range(0, 60_000, 7).select(F.col("id").alias("ms"), metrics.bucket(F.col("id")).alias("low"))
    assert df.where("low > ms OR ms - low > low / 64 OR (ms < 64 AND low <> ms)").count() == 0


def test_events_meet_the_definition_of_their_time(spark, tmp_path):
    defined = definitions.DefinedEvents(spark, f"file://{tmp_path}/d")
    path = {k: f"file://{tmp_path}/{k}" for k in ("control", "events")}

    def arrive(kind, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path[kind])

    def stream(kind, schema):
        return spark.readStream.schema(schema).parquet(path[kind])

    event, ts = "actionId string, ts long, n int", definitions.VERSION
    arrive("control", [("a", 100, "first", 5), ("b", 100, "other", 7), (None, 1, "x", 1)], ts)
    arrive("events", [("a", 99, 1), ("a", 100, 2), ("b", 500, 3), ("c", 500, 4), (None, 500, 5)], event)
    defined.drain_control(stream("control", ts))
    seen = lambda: {(r.n, r.name, r.ttlSeconds) for r in defined.drain_events(stream("events", event)).collect()}
    assert seen() == {(2, "first", 5), (3, "other", 7)}
    arrive("control", [("a", 200, "second", 6), ("b", 300, None, None), ("b", 600, "again", 8), ("a", 200, "second", 6)], ts)
    defined.drain_control(stream("control", ts))
    arrive("events", [("a", 199, 11), ("a", 200, 12), ("b", 299, 13), ("b", 300, 14), ("b", 600, 15)], event)
    assert seen() == {(2, "first", 5), (3, "other", 7), (11, "first", 5), (12, "second", 6), (13, "other", 7), (15, "again", 8)}


def test_loop_back_runs_to_a_fixed_point(spark):
    r = random.Random(3)
    rows = [(f"m{r.randrange(12)}", "completion", r.randrange(5), r.randrange(1_000, 9_000), None) for _ in range(60)]
    rows += [("m1", "completion", None, 5, None), (None, "completion", 0, 5, None), ("m2", "score", 0, 5, None), ("m13", "completion", 0, 1, [("origin", "lake")])]
    got = feedback.run_to_fixed_point(spark, topics.publish(spark.createDataFrame(rows, feedback.EVENT), "done", ["entityId"]), feedback.milestone_chain, "chain").collect()
    want = set()
    for m in {x[0] for x in rows[:60]}:
        done = {}
        for _, _, step, ts, _ in (x for x in rows[:60] if x[0] == m):
            done[step] = min(ts, done.get(step, ts))
        at, k = 0, 0
        while k in done:
            at = max(at, done[k])
            want.add((m, k, at))
            k += 1
    assert {(x.entityId, x.step, x.ts) for x in got if x.kind == "milestone"} == want and max(k for _, k, _ in want) >= 2
    assert Counter(x.kind for x in got) == {"milestone": len(want), "score": len(want)}


def test_a_loop_that_feeds_itself_is_an_error(spark):
    rows = spark.createDataFrame([("m", "completion", 0, 5, None)], feedback.EVENT)
    echo = lambda df: df.select("entityId", "kind", (F.col("step") + 1).alias("step"), "ts", "headers")
    with pytest.raises(RuntimeError, match="still emits"):
        feedback.run_to_fixed_point(spark, topics.publish(rows, "echo", ["entityId"]), echo, "echo", most=3)
