import random
import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import streams
from tidemark.streaming import gates, lifecycle
from tidemark.streaming.lifecycle import Config, Instance, due, step

CFG = Config(debounce_ms=100, ttl_ms=10_000)


def states(*events):
    i, out = Instance(), []
    for ts, kind, *rest in events:
        raw, correlation = (*rest, None, None)[:2]
        out += step(i, ts, kind, raw, correlation, CFG)
    return [(ts, s) for ts, s, _ in out]


def test_lifecycle_paths():
    assert states((0, "CREATE"), (50, "CREATE"), (200, "DISPOSITION", "Delivered")) == [(0, "CREATED"), (100, "IN_PROCESS"), (200, "PRESENTED")]
    assert states((0, "CREATE"), (50, "SUPPRESS")) == [(0, "CREATED"), (50, "SUPPRESSED")]
    assert states((0, "CREATE"), (50, "DEBOUNCE")) == [(0, "CREATED"), (50, "DEBOUNCED")]
    assert states((0, "CREATE"), (150, "SUPPRESS"), (160, "DISPOSITION", "Cancelled"))[-2:] == [(150, "SUPPRESSING"), (160, "SUPPRESSED")]
    assert states((0, "CREATE"), (150, "SUPPRESS"), (160, "DISPOSITION", "AlreadySent"))[-1] == (160, "IN_PROCESS")
    assert states((0, "PRE_DISPATCHED"), (5, "SOFT"), (6, "SOFT"), (7, "DISPOSITION", "Opened"), (8, "HARD"), (9, "SOFT")) == [(0, "IN_PROCESS"), (5, "SOFT_COMPLETED"), (8, "HARD_COMPLETED")]
    assert states((0, "CREATE"), (10_200, "HARD")) == [(0, "CREATED"), (100, "IN_PROCESS"), (10_100, "EXPIRED")]
    assert states((0, "CREATE"), (150, "DISPOSITION", "Bounced"), (200, "CREATE"))[-2:] == [(150, "FAILED"), (200, "CREATED")]
    assert states((0, "PRE_DISPATCHED", None, "c1"), (5, "DISPOSITION", "STOP", "c0"), (6, "DISPOSITION", "STOP", "c1"))[1:] == [(6, "DECLINED")]
    i = Instance()
    step(i, 0, "CREATE", None, None, CFG)
    assert [o[1:] for o in due(i, 100, CFG)] == [("IN_PROCESS", "DISPATCH")]


def history(seed=1, n=400):
    r = random.Random(seed)
    kinds = [("CREATE", None)] * 3 + [("DISPOSITION", x) for x in ("Delivered", "Opened", "STOP", "Bounced", "Cancelled", None)] + [("SOFT", None), ("HARD", None), ("SUPPRESS", None), ("DEBOUNCE", None)]
    return [(f"m{r.randrange(8)}", f"a{r.randrange(2)}", "email", 1_000 * i, i, *r.choice(kinds), None) for i in range(n)]


SCHEMA = "entityId string, actionId string, channel string, ts long, seq long, kind string, raw string, correlationId string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_lifecycle_replay_equals_a_plain_loop(spark):
    events, cfg = history(), Config(debounce_ms=1_500, ttl_ms=60_000)
    want, live = [], {}
    for e in events:
        i = live.setdefault(e[:3], Instance())
        want += [(*e[:3], *o) for o in step(i, e[3], e[5], e[6], e[7], cfg)]
    until = 500_000
    for k, i in live.items():
        want += [(*k, *o) for o in due(i, until, cfg)]
    got = lifecycle.replay_lifecycle(spark.createDataFrame(events, SCHEMA), until, cfg)
    assert rows_of(got) == sorted(want, key=repr)
    assert lifecycle.replay_lifecycle(spark.createDataFrame([], SCHEMA), until, cfg).count() == 0


def drain(spark, df, tmp_path):
    """All rows that a stream appends while it drains its input."""
    out = f"file://{tmp_path}/out-{uuid.uuid4().hex}"
    streams.run_available_now(df, f"file://{tmp_path}/check-{uuid.uuid4().hex}", streams.idempotent_batch(spark, out, streams.overwrite_parquet))
    return spark.read.option("basePath", out).parquet(f"{out}/*").drop("batch")


def in_files(spark, rows, schema, tmp_path, parts):
    """The rows as some files in the order of arrival, read one file a micro-batch."""
    path = f"{tmp_path}/in-{uuid.uuid4().hex}"
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"file://{path}")
    return streams.read_files(spark, f"file://{path}", schema, max_files=1)


def test_stream_of_lifecycles_equals_the_batch_twin(spark, tmp_path):
    events, cfg = history(3, 120), Config(debounce_ms=1_500, ttl_ms=60_000)
    # An event far in the future moves the watermark past all deadlines; its own key stays out of the comparison.
    late = [("end", "a", "email", 10_000_000, 999, "HARD", None, None), ("end", "a", "email", 10_000_001, 1_000, "HARD", None, None)]
    stream = in_files(spark, [*events, *late], SCHEMA, tmp_path, 4).withColumn("at", F.timestamp_millis("ts")).withWatermark("at", "0 seconds")
    got = drain(spark, lifecycle.stream_lifecycle(stream, cfg), tmp_path)
    want = lifecycle.replay_lifecycle(spark.createDataFrame(events, SCHEMA), 9_999_999, cfg)
    assert rows_of(got.select(want.columns)) == rows_of(want)


def test_throttle_golden_cases_and_stream(spark, tmp_path):
    decide = gates.throttle_decision
    assert [decide(n, 0, 0, 2, 0, 300_000) for n in range(3)] == ["SEND", "SEND", "WAIT"]
    assert decide(1, 0, 288, 1, 0, 300_000) == "SUPPRESS" and decide(9, 9, 9, None, 0, 300_000) == "SEND"
    rows = [(i, "email" if i % 2 else "mail", 0, t, 0) for i, t in enumerate([0, 500, 1_000, 1_500, 301_000, 301_500, 302_000, 302_100])]
    schema = "id long, channel string, shard int, ts long, lakeRate long"
    batch = gates.throttle(spark.createDataFrame(rows, schema), {"email": 1}, 300_000)
    want = {r.id: r.decision for r in batch.collect()}
    assert [want[i] for i in (1, 3, 5, 7)] == ["SEND", "WAIT", "SEND", "WAIT"] and {want[i] for i in (0, 2, 4, 6)} == {"SEND"}
    for parts in (1, 3):
        got = drain(spark, gates.stream_throttle(in_files(spark, rows, schema, tmp_path, parts), {"email": 1}, 300_000), tmp_path)
        assert {r.id: r.decision for r in got.collect()} == want


def test_shards_keep_a_cap_together(spark):
    rows = [(i, "email", i % 4, i, 0) for i in range(40)]
    for cap in range(1, 9):
        got = gates.throttle(spark.createDataFrame(rows, "id long, channel string, shard int, ts long, lakeRate long"), {"email": cap}, 300_000, shards=4).collect()
        assert len(got) == 40 and sum(r.decision == "SEND" for r in got) == cap
        assert sum(gates.cap_share(cap, k, 4) for k in range(4)) == cap


@pytest.mark.parametrize("window_ms,cap,ranges", [(1_000, 3, 9), (60_000, 5, 17), (300_000, 40, 5), (86_400_000, 2, 8), (7_000_000, 1, 30)])
def test_throttle_by_prefix_scan_equals_the_sequence(spark, window_ms, cap, ranges):
    """A hot channel over many ranges, bursts, equal times, rates over the cap and midnights, against a plain loop."""
    r, at, rows = random.Random(window_ms), 86_400_000 * 3 - 4_000_000, []
    for i in range(1_500):
        at += r.choice([0, 0, 1, 30, 900, 20_000, r.randrange(window_ms + 2) if i % 50 == 0 else 5])
        rows.append((i, r.choice(["email"] * 8 + ["sms", "mail", None]), r.randrange(2), at, r.choice([0, 0, 0, cap - 1, cap, cap + 5])))
    caps, want, state = {"email": cap, "sms": 1}, {}, {}
    for i, channel, shard, ts, rate in sorted(rows, key=lambda x: (x[3], x[0])):
        now = state.get((channel, shard), gates.FRESH)
        decision, state[channel, shard] = gates._step(now, ts, rate, caps.get(channel), gates.cap_share(caps.get(channel), shard, 2), window_ms)
        want[i] = decision
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = gates.throttle(spark.createDataFrame(rows, "id long, channel string, shard int, ts long, lakeRate long"), caps, window_ms, shards=2).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert {x.id: x.decision for x in got} == want and len(got) == len(want) and set(want.values()) >= {"SEND", "WAIT"}


def test_waiting_function_is_the_sequence():
    r = random.Random(2)
    for window_ms in (1_000, 3_600_000, 30_000_000):
        ts = np.sort(np.array([r.randrange(2 * 86_400_000) for _ in range(60)]))
        before, after = gates._waiting_function(ts, 3, window_ms)
        for w in [*range(40), before[-1] - 1, before[-1]]:
            now = w
            for t in ts:
                now += gates.throttle_decision(9, 0, now, 9, int(t), window_ms, 3) == "WAIT"
            assert now == (w if w >= before[-1] else int(np.interp(w, before, after)))


def test_touch_and_fold_streams_do_not_depend_on_how_input_is_split(spark, tmp_path):
    sends = [(i, "m1", c, i) for i, c in enumerate(["email", "push", "email", "email", "sms"])]
    schema = "id long, entityId string, channel string, ts long"
    for parts in (1, 3):
        got = drain(spark, gates.stream_touch(in_files(spark, sends, schema, tmp_path, parts), {"email": ["t0", "t1"], "push": ["t0"]}, "base"), tmp_path)
        assert {r.id: r.template for r in got.collect()} == {0: "t0", 1: "t0", 2: "t1", 3: "t1", 4: "base"}
    facts = [("m1", "k", "new", 5), ("m1", "k", "old", 3), ("m1", "j", "x", 1), ("m1", "k", "newer", 7)]
    schema = "entityId string, key string, value string, eventTs long"
    for parts in (1, 4):
        got = drain(spark, gates.stream_fold(in_files(spark, facts, schema, tmp_path, parts)), tmp_path)
        latest = got.groupBy("key").agg(F.max_by("value", "eventTs").alias("value"))
        assert dict(map(tuple, latest.collect())) == {"k": "newer", "j": "x"}
        assert got.where("value = 'old'").count() == 0


def at(seconds):
    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


def test_ingress_dedup_and_live_windows(spark, tmp_path):
    rows = [(1, at(1), "email"), (1, at(2), "email"), (2, at(3), "email"), (3, at(3600), "sms")]
    schema = "id long, at timestamp, channel string"
    got = drain(spark, streams.dedup_ingress(in_files(spark, rows, schema, tmp_path, 2), ["id"], "at", "1 minute"), tmp_path)
    assert sorted(r.id for r in got.collect()) == [1, 2, 3]
    live = drain(spark, streams.live_metrics(in_files(spark, rows, schema, tmp_path, 4), "at", "10 seconds", "1 second"), tmp_path)
    assert [(r.channel, r.events) for r in live.collect()] == [("email", 3)]


def test_a_retried_batch_replaces_itself(spark, tmp_path):
    each = streams.idempotent_batch(spark, f"file://{tmp_path}/t", streams.overwrite_parquet)
    for _ in range(2):
        each(spark.range(3), 0)
    each(spark.range(2), 1)
    assert spark.read.parquet(f"file://{tmp_path}/t/*").count() == 5
