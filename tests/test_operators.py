"""Golden cases and properties of operators that the SQL comparison does not reach: nulls, ties, empty tables, plain loops."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.conditions import tree_to_column
from tidemark.operators import ingest, joining, learning, merging, reports, rules
from tidemark.sources import tables

FACTS = {"n": "5", "s": "abc", "t": "true", "one": "1", "bad": "x"}


@pytest.mark.parametrize(("leaf", "want"), [
    (("n", "gt", 4), True), (("n", "gte", 5), True), (("n", "lt", 5), False), (("n", "lte", 5), True), (("n", "eq", 5), True), (("n", "ne", 5), False),
    (("missing", "lt", 1), True), (("missing", "gt", 0), False), (("missing", "exists", None), False), (("n", "exists", None), True), (("bad", "eq", 0), True),
    (("s", "eq", "abc"), True), (("s", "in", ["x", "abc"]), True), (("s", "in", "x, abc"), True), (("s", "in", "x"), False), (("missing", "eq", ""), True),
    (("t", "eq", True), True), (("one", "eq", True), True), (("missing", "eq", False), True), (("missing", "ne", True), True),
])
def test_comparisons(spark, leaf, want):
    facts = F.create_map(*[F.lit(x) for kv in FACTS.items() for x in kv])
    condition = dict(zip(("fact", "cmp", "value"), leaf, strict=True))
    assert spark.range(1).select(tree_to_column(facts, condition)).first()[0] is want


def test_nested_trees_and_empty_ones(spark):
    facts = F.create_map(F.lit("n"), F.lit("5"))
    yes, no = {"fact": "n", "cmp": "eq", "value": 5}, {"fact": "n", "cmp": "eq", "value": 6}
    trees = [None, {}, {"op": "any", "conditions": []}, {"op": "any", "conditions": [no, {"op": "all", "conditions": [yes, yes]}]}, {"op": "all", "conditions": [yes, {"op": "any", "conditions": [no, no]}]}]
    assert list(spark.range(1).select(*(tree_to_column(facts, t) for t in trees)).first()) == [True, True, True, True, False]


def test_content_variants(spark):
    always, never = {"contentKey": "v", "percent": 100}, {"contentKey": "v", "percent": 0}
    members = spark.range(2000).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("m"))
    facts = F.create_map().cast("map<string,string>")
    pick = lambda v: members.select(rules.content_key(F.col("m"), facts, "base", [v], "a").alias("k")).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in pick(always)} == {"v": 2000} and {r.k: r["count"] for r in pick(never)} == {"base": 2000}
    share = {r.k: r["count"] for r in pick({"contentKey": "v", "percent": 30})}["v"]
    assert 450 < share < 750


def test_java_hash_equals_java(spark):
    def java(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    words = ["", "a", "hello", "op-12345:action_1", "Zz~!" * 9]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", scalars.java_hash(F.col("w"))).collect()
    assert {r[0]: r[1] for r in got} == {w: java(w) for w in words}


CANDIDATE = "entityId string, actionId string, channel string, score double, eligible boolean, active boolean, cancellable boolean, softCompleted boolean, hardCompleted boolean"


def candidates(spark, rows):
    return spark.createDataFrame([("m", *r) for r in rows], CANDIDATE)


def test_router_cases(spark):
    route = lambda rows: sorted((r.op, r.actionId) for r in rules.route(candidates(spark, rows), ["entityId"]).collect())
    t, f = True, False
    free = lambda a, s: (a, "email", s, t, f, f, f, f)
    assert route([free("b", 0.5), free("a", 0.5)]) == [("CREATE", "a")]
    assert route([free("a", None)]) == []
    assert route([("a", "email", 0.9, t, t, f, f, f), free("b", 1.0)]) == []  # sent: it holds the slot
    assert route([("a", "email", 0.9, t, t, t, f, f), free("b", 1.0)]) == [("SUPPRESS", "a")]
    assert route([("a", "email", 0.9, t, t, t, f, f), free("b", 0.9)]) == []
    assert route([("a", "email", 0.9, f, t, t, f, f), free("b", 0.1)]) == [("CREATE", "b"), ("SUPPRESS", "a")]
    assert route([("a", "email", 0.9, t, t, f, t, t)]) == [("HARD_COMPLETE", "a")]
    batch = rules.select_batch(candidates(spark, [free("a", 0.1), free("b", 0.9), free("c", 0.5)]), ["entityId"], {"email": 2}).collect()
    assert sorted((r.place, r.actionId) for r in batch) == [(1, "b"), (2, "c")]
    assert rules.route(candidates(spark, []), ["entityId"]).count() == 0


def test_last_writer_wins(spark):
    schema = "k string, value string, eventTs long"
    table = spark.createDataFrame([("a", "old", 5), ("b", "keep", 9), (None, "n", 1)], schema)
    incoming = spark.createDataFrame([("a", "older", 4), ("b", "tie", 9), ("c", "new", 1), (None, "m", 2)], schema)
    got = {r.k: r.value for r in merging.merge_lww(table, incoming, ["k"]).collect()}
    assert got == {"a": "old", "b": "tie", "c": "new", None: "m"}
    assert {r.k for r in merging.changed_only(table, incoming, ["k"]).collect()} == {"a", "b", "c", None}
    assert merging.merge_lww(table.limit(0), incoming.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_a_plain_loop(spark, strict):
    r = random.Random(1)
    left = [(f"m{r.randrange(4)}", r.randrange(30), i) for i in range(60)]
    right = [(f"m{r.randrange(4)}", r.randrange(30), i) for i in range(40)]
    want = []
    for m, ts, i in left:
        before = [(t, x) for k, t, x in right if k == m and (t < ts or t == ts and not strict)]
        want.append((m, ts, i, *(max(before) if before else (None, None))))
    got = joining.asof_join(spark.createDataFrame(left, "m string, ts long, i long"), spark.createDataFrame(right, "m string, rts long, x long"), ["m"], "ts", "rts", ["x"], strict)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_malformed_rows_replay_to_what_they_were(spark):
    rows = [("t", 0, i, f"k{i}", v, None) for i, v in enumerate(['{"a": 1}', "[1]", None, "{", "text"])]
    df = spark.createDataFrame(rows, "topic string, partition int, offset long, key string, value string, headers map<string,string>")
    good, bad = ingest.split_malformed(df, "value", "a LONG")
    assert [r.data.a for r in good.collect()] == [1]
    dlq = ingest.to_dlq(bad, "c", 7)
    assert {r.offset: r.error for r in dlq.collect()} == {1: "not a JSON object", 2: "empty payload", 3: "malformed JSON", 4: "not a JSON object"}
    again = ingest.replay_dlq(dlq, "c", dlq.where("offset = 4"))
    assert sorted((r.offset, r.key, r.value) for r in again.collect()) == [(1, "k1", "[1]"), (2, "k2", None), (3, "k3", "{")]


def test_playbook_equals_a_plain_loop(spark):
    rows = [(f"m{i % 7}", f"a{i % 5}", "email", i % 3 > 0) for i in range(35)]
    journeys = [(j, s, f"a{(j + s) % 5}") for j in range(2) for s in range(3)] + [(2, 0, "none")]
    got = learning.playbook_score(spark.createDataFrame(rows, "entityId string, actionId string, channel string, eligible boolean"), spark.createDataFrame(journeys, "journey int, step int, actionId string"), ["entityId"]).collect()
    for m in {r[0] for r in rows}:
        steps = {a: s for j, s, a in journeys if j == zlib.crc32(m.encode()) % 3}
        first = min((steps[a] for x, a, _, ok in rows if x == m and ok and a in steps), default=None)
        other = min((a for x, a, _, ok in rows if x == m and ok), default=None)
        for r in got:
            if r.entityId == m:
                assert r.playbook == int(r.eligible and (steps.get(r.actionId) == first if first is not None else r.actionId == other))


def test_trained_models_beat_chance(spark):
    rows = [(f"c{i}", float(i % 10), int(i % 10 > 5), "real" if i % 3 else "sim") for i in range(300)]
    x = spark.createDataFrame(rows, "correlationId string, f double, label int, source string")
    models = learning.train_propensity(x, ["f"], models=2, trees=2)
    from pyspark.ml.feature import VectorAssembler

    scored = models[0].transform(VectorAssembler(inputCols=["f"], outputCol="features").transform(x)).select("label", "prediction")
    assert learning.auc(scored, "prediction", "label").first()[0] > 0.9
    trans = spark.createDataFrame([([float(i % 2), 1.0], i % 2) for i in range(100)], "obs array<double>, arm int")
    from pyspark.ml.functions import array_to_vector

    out = learning.behaviour_clone(trans, 2).transform(trans.select("arm", array_to_vector("obs").alias("features")))
    assert out.where("prediction = arm").count() == 100


def test_a_time_of_zero_is_none(spark):
    shapes = ['{"entityId": "m", "key": "k", "value": 1, "ts": 0, "eventTs": 7}', '{"entityId": "n", "key": "k", "value": 1, "ts": 0}', '{"entityId": "o", "key": "k", "value": 1, "ts": 3, "eventTs": 7}']
    got = ingest.normalize_inbound(spark.createDataFrame([(x,) for x in shapes], "payload string"), default_ts=99).collect()
    assert {r.entityId: r.eventTs for r in got} == {"m": 7, "n": 99, "o": 3}


def test_arms_of_nested_gates_and_leftovers_of_tests(spark):
    gate = '{"op":"all","conditions":[{"fact":"operator.activity.daysSinceLogin","cmp":"lte","value":30},{"op":"any","conditions":[{"value":3,"cmp":"gte","fact":"operator.activity.completedTasks"}]}]}'
    docs = [
        ("ACTION:a", f'{{"id":"a","name":"A","channels":[{{"channel":"email"}},{{"channel":"sms"}}],"inclusion":{gate},"completion":{{"fact":"operator.activity.hraCompleted","cmp":"gte","value":1}}}}', 1),
        ("ACTION:b", '{"id":"b","name":"B","channels":[{"channel":"push","contentKey":"x"},{"channel":""}],"inclusion":{"conditions":[]}}', 1),
        ("ACTION:c", '{"id":"c","name":"ComplCrit","channels":[{"channel":"push"}]}', 1),
        ("ACTION:d", '{"id":"d","name":"D","channels":[{"channel":"push","contentKey":"vtest-1"}]}', 1),
        ("ACTION:e", '{"id":"e","name":"E","channels":[]}', 1),
    ]
    dim = ingest.parse_definition(spark.createDataFrame(docs, "key string, value string, updatedTs long"))
    got = ingest.load_arms(dim).orderBy("arm").collect()
    assert [(r.actionId, r.channel, r.group, r.drives, r.arm) for r in got] == [("a", "email", "engaged", "hraCompleted", 0), ("a", "sms", "engaged", "hraCompleted", 1), ("b", "push", "activated", None, 2)]


def test_arm_lookup_falls_back_to_the_channel_and_can_hold(spark):
    rows = [("m", "a", "email", True, False), ("m", "new", "sms", True, False), ("m", "a", "mail", True, False), ("n", "a", "email", False, False), ("n", "a", "sms", True, True), ("o", "a", "sms", True, False), ("p", "x", "email", True, False)]
    c = spark.createDataFrame(rows, "entityId string, actionId string, channel string, eligible boolean, hardCompleted boolean")
    artifact = {"arms": [{"actionId": "a", "channel": "email"}, {"actionId": "b", "channel": "sms"}, {"actionId": "a", "channel": "sms"}], "noop_index": 3}
    q = spark.createDataFrame([("m", [0.1, 0.7, 0.2, 0.3]), ("n", [0.9, 0.9, 0.9, 0.1]), ("p", [0.2, 0.0, 0.0, 0.8])], "entityId string, q array<double>")
    scored = learning.arm_scores(c, q, artifact, ["entityId"])
    assert {(r.entityId, r.actionId, r.channel): r.score for r in scored.collect()} == {
        ("m", "a", "email"): 0.1, ("m", "new", "sms"): 0.7, ("m", "__hold", "hold"): 0.3, ("o", "a", "sms"): 0.0, ("p", "x", "email"): 0.2, ("p", "__hold", "hold"): 0.8,
    }
    assert {(r.entityId, r.actionId) for r in learning.chosen_arm(scored, ["entityId"]).collect()} == {("m", "new"), ("o", "a"), ("p", "__hold")}


def test_selection_equals_sorting(spark):
    from tidemark.operators import selection

    r = random.Random(4)
    for values in ([], [None, float("nan")], [3.0], [2.0] * 50, [r.choice([0.0, 1e-300, 1.0, 1e300, -1e300, r.gauss(0, 1)]) for _ in range(700)], [1.0, math.nextafter(1.0, 2.0)] * 9):
        df = spark.createDataFrame([(x,) for x in values], "x double")
        known = sorted(x for x in values if x is not None and x == x)
        for share in (0.0, 0.3, 0.5, 0.95, 1.0):
            want = known[max(1, math.ceil(share * len(known))) - 1] if known else None
            assert selection.value_at(df, "x", share) == want
    rows = [(i * 0.5, r.randrange(9)) for i in range(200)]
    got = selection.with_prefix(spark.createDataFrame(r.sample(rows, 200), "k double, n long"), "k", "n", "below").collect()
    assert {x.k: x.below for x in got} == {k: sum(n for j, n in rows if j < k) for k, _ in rows}


def test_clone_gate(spark):
    rows = [(0.5, 0.6), (0.4, 0.6), (0.1, 0.11), (0.11, 0.14), (None, 0.5)]
    got = [learning.clone_gate(spark.createDataFrame([x], "agreement double, cloneAgreement double")).first().promote for x in rows]
    assert got == [True, False, False, False, False]


def test_bootstrap_is_idempotent(spark, tmp_path):
    name = f"lake_{tmp_path.name.replace('-', '_')}"
    spark.sql(f"CREATE DATABASE {name} LOCATION 'file://{tmp_path}/{name}'")
    first = merging.ensure_tables(spark, name)
    assert merging.ensure_tables(spark, name) == first and all(spark.table(t).count() == 0 for t in first)
    assert all(t.endswith("_shadow") for t in merging.ensure_tables(spark, name, shadow=True))
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_no_rows_are_no_problem(spark):
    e = spark.createDataFrame([], "entityId string, key string, value string, eventTs long, valueType string")
    assert ingest.member_fact_map(e).count() == 0 and ingest.with_fact_dims(e).count() == 0
    assert reports.net_sends(ingest.with_fact_dims(e), {"x": 0}, 1).count() == 0
    assert [r.members for r in rules.rule_funnel(ingest.member_fact_map(e), [("all", None)]).collect()] == [0]
    assert ingest.lean_filter(e, e.select("key")).count() == 0


def test_sql_tables_name_what_they_need():
    assert set(tables.NEEDS) <= set(tables.SQL)
