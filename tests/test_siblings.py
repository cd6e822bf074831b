"""The sibling debounce: golden cases, the batch twin against a plain loop, the stream against the twin, losers end lifecycles."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import lifecycle, siblings, topics
from tidemark.streaming.siblings import Config, Sibling, due, step

CFG = Config(debounce_ms=100, recheck_ms=50, checks=3)


def verdicts(*events):
    known, out = {}, []
    for slug, ts, kind, *rest in events:
        state, score = (*rest, None, None)[:2]
        out += step(known, (slug, "email"), ts, kind, state, score, None, CFG)
    return [(s, ts, v) for s, _, ts, v, _ in out + due(known, 10_000, CFG)]


def test_golden_cases():
    assert verdicts(("a", 0, "CREATE", None, 0.5)) == [("a", 100, "SEND")]
    assert verdicts(("a", 0, "CREATE", None, 0.5), ("b", 0, "CREATE", None, 0.9)) == [("a", 100, "LOSE"), ("b", 100, "SEND")]
    assert verdicts(("a", 0, "CREATE", None, 0.5), ("b", 0, "CREATE", None, 0.5)) == [("a", 100, "SEND"), ("b", 100, "LOSE")]
    assert verdicts(("a", 0, "CREATE", None, None), ("b", 10, "STATE", "PRESENTED")) == [("a", 100, "LOSE")]
    assert verdicts(("a", 0, "CREATE", None, 0.1), ("b", 10, "STATE", "IN_PROCESS")) == [("a", 100, "WAIT"), ("a", 150, "WAIT"), ("a", 200, "SEND")]
    assert verdicts(("a", 0, "CREATE", None, 0.1), ("b", 10, "STATE", "IN_PROCESS"), ("b", 120, "END")) == [("a", 100, "WAIT"), ("a", 150, "SEND")]
    assert verdicts(("a", 0, "CREATE", None, 0.1), ("b", 10, "STATE", "IN_PROCESS"), ("b", 120, "STATE", "DECLINED")) == [("a", 100, "WAIT"), ("a", 150, "LOSE")]
    assert verdicts(("a", 0, "CREATE", None, 0.1), ("a", 60, "CREATE", None, 0.9), ("b", 90, "CREATE", None, 0.5)) == [("a", 100, "LOSE"), ("b", 190, "SEND")]
    assert due({("a", "x"): Sibling("PRESENTED")}, 10**9, CFG) == []


def history(seed, n=240):
    r = random.Random(seed)
    kinds = [("CREATE", None)] * 5 + [("STATE", s) for s in ("PRESENTED", "DECLINED", "IN_PROCESS", "SUPPRESSING", None)] + [("END", None)]
    return [(f"m{r.randrange(6)}", f"a{r.randrange(4)}", r.choice(["email", "sms", None]), 1_000 + 40 * i, i, *r.choice(kinds), r.choice([None, 0.25, 0.5, 0.5, 0.75]), f"c{i}") for i in range(n)]


SCHEMA = "entityId string, actionId string, channel string, ts long, seq long, kind string, state string, score double, correlationId string"


def plain(events, until):
    known, out = {}, []
    for m, a, c, ts, _, kind, state, score, correlation in events:
        own = known.setdefault(m, {})
        out += [(m, *v) for v in step(own, (a, c or ""), ts, kind, state, score, correlation, CFG)]
    return sorted(out + [(m, *v) for m, own in known.items() for v in due(own, until, CFG)], key=repr)


@pytest.mark.parametrize("steps,max_files", [(1, 100), (4, 1), (7, 100)])
def test_stream_and_replay_equal_a_plain_loop(spark, steps, max_files):
    events = spark.createDataFrame(history(steps), SCHEMA)
    want = plain(history(steps), 10**6)
    assert sorted(map(tuple, siblings.replay_siblings(events, ["entityId"], 10**6, CFG).collect()), key=repr) == want
    topic = topics.publish(events, "events", ["entityId"], steps=steps, idle_ms=10**6)
    with topics.rocksdb(spark):
        got = topics.drain(siblings.stream_siblings(topic.stream(spark, max_files), ["entityId"], CFG), "verdicts")
    assert sorted(map(tuple, got.collect()), key=repr) == want and {v[4] for v in want} == {"LOSE", "WAIT", "SEND"}


def test_empty_input(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert siblings.replay_siblings(none, ["entityId"], 100, CFG).count() == 0
    topic = topics.publish(none, "none", ["entityId"], idle_ms=100)
    with topics.rocksdb(spark):
        assert topics.drain(siblings.stream_siblings(topic.stream(spark), ["entityId"], CFG), "none").count() == 0


def test_losers_end_the_stream_of_lifecycles(spark):
    """Two topics in a row: verdicts drained from the one are signals in the other."""
    creates = spark.createDataFrame([("m", "a", "email", 1_000, 0.9, "c1"), ("m", "b", "email", 1_000, 0.5, "c2"), ("n", "b", "email", 1_005, 0.1, "c3")], "entityId string, actionId string, channel string, ts long, score double, correlationId string")
    states = spark.createDataFrame([], "entityId string, actionId string, channel string, ts long, state string")
    topic = topics.publish(siblings.sibling_events(creates, states, ["entityId"]), "contest", ["entityId"], idle_ms=10_000)
    with topics.rocksdb(spark):
        lost = siblings.debounce_signals(topics.drain(siblings.stream_siblings(topic.stream(spark), ["entityId"], CFG), "lost"))
    events = lifecycle.lifecycle_events(creates.withColumn("op", F.lit("CREATE")), lost.limit(0).withColumn("raw", F.lit("")), lost)
    cfg = lifecycle.Config(debounce_ms=101, ttl_ms=5_000)
    moves = topics.publish(events, f"moves{uuid.uuid4().hex}", lifecycle.KEY, idle_ms=10_000)
    got = topics.drain(lifecycle.stream_lifecycle(moves.stream(spark), cfg), "states").where("entityId <> '0'")
    assert {(r.entityId, r.actionId, r.ts, r.state) for r in got.collect()} == {
        ("m", "a", 1_000, "CREATED"), ("m", "a", 1_101, "IN_PROCESS"), ("m", "a", 6_101, "EXPIRED"), ("m", "b", 1_000, "CREATED"), ("m", "b", 1_100, "DEBOUNCED"),
        ("n", "b", 1_005, "CREATED"), ("n", "b", 1_106, "IN_PROCESS"), ("n", "b", 6_106, "EXPIRED"),
    }
