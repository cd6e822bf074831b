"""Queries: training sets, scorers, policies and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import softmax, stable01
from tidemark.operators import learning
from tidemark.operators.ingest import CHANNELS, member_fact_map, pivot_features
from tidemark.plans import rules as rules_plan
from tidemark.plans.ingest import FEATURES
from tidemark.plans.register import Register
from tidemark.sources import tables as T

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql

BY = ["entityId", "evaluatedAt"]
DAY = T.DAY_MS


def examples(spark, sf_dir):
    """A labelled example for each contact; its propensity falls with the member's contacts on the channel."""
    s = T.sends(spark, sf_dir)
    p = 1 / (1 + F.substring("correlationId", 3, 20).cast("long") % 9)
    return s.where("status <> 'P'").select("correlationId", "entityId", "actionId", "channel", "decisionTs", (F.col("status") == "F").cast("int").alias("label"), p.alias("propensity"))


EXAMPLES = "x AS (SELECT correlationId, entityId, actionId, channel, decisionTs, (status = 'F')::INT AS label, 1 / (1 + substr(correlationId, 3)::BIGINT % 9) AS propensity FROM sends WHERE status <> 'P')"


@query(T.oracle("sends", EXAMPLES + " SELECT actionId, channel, count(*) AS n, 1 + sum(label) AS alpha, 1 + count(*) - sum(label) AS beta, (1 + sum(label)) / (2 + count(*)) AS mean FROM x GROUP BY ALL"))
def a22_arm_posteriors(spark, sf_dir):
    out = learning.arm_posteriors(examples(spark, sf_dir))
    return out


@query(T.oracle("sends", EXAMPLES + ", w AS (SELECT *, 1 / least(greatest(propensity, 0.05), 1.0) AS w FROM x) SELECT round(sum(w * label) / sum(w), 9) AS value, count(*) AS n FROM w"))
def a23_snips(spark, sf_dir):
    return learning.snips(examples(spark, sf_dir)).withColumn("value", F.round("value", 9))


@query(T.oracle("sends", EXAMPLES + """, c AS (SELECT *, (('0x' || substr(md5(correlationId), 1, 8))::BIGINT / 4294967295::DOUBLE) AS score FROM x), m AS (SELECT quantile_disc(score, 0.5) AS middle FROM c),
    w AS (SELECT *, 1 / least(greatest(propensity, 0.05), 1.0) AS w FROM c, m WHERE score >= middle) SELECT round(sum(w * label) / sum(w), 9) AS value, count(*) AS n FROM w"""))
def a23_snips_challenger(spark, sf_dir):
    return learning.snips(examples(spark, sf_dir).withColumn("score", stable01(F.col("correlationId"))), "score").withColumn("value", F.round("value", 9))


@query(T.oracle("sends", EXAMPLES + " SELECT actionId, count(*) AS n, round(greatest(0.03, least(0.30, 0.30 * exp(-count(*) / 20000.0::DOUBLE))), 9) AS temperature FROM x GROUP BY actionId"))
def a24_anneal_temperature(spark, sf_dir):
    return examples(spark, sf_dir).groupBy("actionId").agg(F.count(F.lit(1)).alias("n")).withColumn("temperature", F.round(learning.anneal_temperature(F.col("n")), 9))


@query(T.oracle("sends", EXAMPLES + """, c AS (SELECT label, (('0x' || substr(md5('model|' || correlationId), 1, 8))::BIGINT / 4294967295::DOUBLE) * 0.5 + (decisionTs // 86400000 % 7) / 14.0::DOUBLE AS score FROM x), p AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM c GROUP BY ALL),
    b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM p) SELECT round((sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)))::DOUBLE, 9) AS auc, (SELECT round(corr(score, label), 9) FROM c) AS corr FROM b"""))
def a27_model_quality(spark, sf_dir):
    """Of a score that knows nothing of the label: a stable number and the day of the week."""
    score = stable01(F.lit("model"), F.col("correlationId")) * 0.5 + F.expr("decisionTs div 86400000 % 7") / F.lit(14.0)
    x = examples(spark, sf_dir).withColumn("score", score)
    return learning.auc(x, "score", "label").crossJoin(x.agg(F.round(F.corr("score", "label"), 9).alias("corr"))).withColumn("auc", F.round("auc", 9))


@query(T.oracle("sends states", """b AS (SELECT entityId, actionId, channel, decisionTs, max(correlationId) AS correlationId FROM sends GROUP BY ALL), n AS (SELECT *, lead(decisionTs) OVER (PARTITION BY entityId, actionId, channel ORDER BY decisionTs) AS nextTs FROM b),
    e AS (SELECT n.correlationId, list(DISTINCT s.state) AS st FROM states s JOIN n ON s.entityId = n.entityId AND s.actionId = n.actionId AND s.channel = n.channel AND n.decisionTs <= s.stTs AND (n.nextTs IS NULL OR s.stTs < n.nextTs) GROUP BY ALL)
    SELECT correlationId, CASE WHEN list_contains(st, 'HARD_COMPLETED') THEN 1 WHEN list_contains(st, 'PRESENTED') THEN 0 END AS label FROM e"""))
def a21_m2_episode_labels(spark, sf_dir):
    from tidemark.operators.joining import episode_states

    by = ["entityId", "actionId", "channel"]
    e = episode_states(T.sends(spark, sf_dir), T.states(spark, sf_dir).drop("correlationId"), by).groupBy("correlationId").agg(F.collect_set("state").alias("st"))
    return e.select("correlationId", learning.episode_label(F.col("st")).alias("label"))


@query(T.oracle("sends states", f"""b AS (SELECT entityId, actionId, channel, decisionTs, max(correlationId) AS correlationId FROM sends GROUP BY ALL), n AS (SELECT *, lead(decisionTs) OVER (PARTITION BY entityId, actionId, channel ORDER BY decisionTs) AS nextTs FROM b),
    e AS (SELECT n.entityId, n.decisionTs, n.correlationId, list(DISTINCT s.state) AS st FROM states s JOIN n ON s.entityId = n.entityId AND s.actionId = n.actionId AND s.channel = n.channel AND n.decisionTs <= s.stTs AND (n.nextTs IS NULL OR s.stTs < n.nextTs) GROUP BY ALL),
    l AS (SELECT *, CASE WHEN list_contains(st, 'HARD_COMPLETED') THEN 1 WHEN list_contains(st, 'PRESENTED') THEN 0 END AS label FROM e),
    c AS (SELECT correlationId, count(*) OVER (PARTITION BY entityId, channel ORDER BY decisionTs RANGE BETWEEN {14 * DAY} PRECEDING AND 1 PRECEDING) AS thisChannelRecentN FROM sends),
    p AS (SELECT entityId, decisionTs AS snapTs, count(*) AS nSent FROM sends WHERE channel = 'email' GROUP BY ALL)
    SELECT l.correlationId, l.label, c.thisChannelRecentN, p.nSent, p.snapTs FROM l JOIN c USING (correlationId) ASOF JOIN p ON l.entityId = p.entityId AND l.decisionTs >= p.snapTs WHERE l.label IS NOT NULL"""))
def m3_training_set(spark, sf_dir):
    s = T.sends(spark, sf_dir)
    snaps = s.where("channel = 'email'").groupBy("entityId", F.col("decisionTs").alias("snapTs")).agg(F.count(F.lit(1)).alias("nSent"))
    log = T.candidates(spark, sf_dir).select("entityId", "actionId", F.col("score").alias("propensity"))
    out = learning.training_set(s, T.states(spark, sf_dir).drop("correlationId"), snaps, log)
    return out.select("correlationId", "label", "thisChannelRecentN", "nSent", "snapTs")


def _points(spark, sf_dir):
    """Decision points with a five-milestone observation that grows with the member's contacts."""
    from pyspark.sql import Window

    t = T.touches(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("entityId").orderBy("ts", "touchId"))
    t = t.withColumn("n", n).withColumn("arm", F.when(F.col("touchId") % 7 == 0, -1).otherwise((F.col("touchId") % 5).cast("int")))
    flags = [(F.col("n") > k).cast("double") for k in (1, 3, 8, 20, 60)]
    return t.withColumn("obs", F.array((F.col("n") / 10.0), *flags)).select("entityId", "touchId", "ts", "arm", "obs")


POINTS = "p AS (SELECT *, row_number() OVER (PARTITION BY entityId ORDER BY ts, touchId) AS n, CASE WHEN touchId % 7 = 0 THEN -1 ELSE touchId % 5 END AS arm, lead(ts) OVER (PARTITION BY entityId ORDER BY ts, touchId) IS NULL AS last FROM touches)"
GAIN = "(CASE WHEN last THEN 0 ELSE (CASE n WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 8 THEN 4 WHEN 20 THEN 8 WHEN 60 THEN 20 ELSE 0 END) END)"
NEXT = "(CASE WHEN last THEN n ELSE n + 1 END)"
POTENTIAL = "((({0}) > 1)::INT * 1 + (({0}) > 3)::INT * 2 + (({0}) > 8)::INT * 4 + (({0}) > 20)::INT * 8 + (({0}) > 60)::INT * 20)"


@query(T.oracle("touches", POINTS + f""", r AS (SELECT *, {GAIN} - CASE WHEN arm >= 0 THEN 0.15 ELSE 0 END AS reward, (last OR {NEXT} > 60)::INT AS done FROM p)
    SELECT touchId, round(reward, 9)::DOUBLE AS reward, done::DOUBLE AS done, round((({NEXT}) / 10.0)::DOUBLE, 9) AS nextFirst, round(((reward + 0.97 * {POTENTIAL.format(NEXT)} * (1 - done) - {POTENTIAL.format('n')}) * 0.1)::DOUBLE, 9) AS shaped FROM r"""))
def w11_a28_m4_transitions(spark, sf_dir):
    t = learning.shape_reward(learning.transitions(_points(spark, sf_dir), "entityId", "ts", 1, ["touchId"]), 1)
    return t.select("touchId", F.round("reward", 9).alias("reward"), "done", F.round(F.get("next_obs", F.lit(0)), 9).alias("nextFirst"), F.round("shaped", 9).alias("shaped"))


@query(T.oracle("touches", POINTS + ", f AS (SELECT unnest(range(6)) AS dim) SELECT dim::INT AS dim, round(avg(x), 9) AS mean, round(CASE WHEN stddev_pop(x) < 1e-9 THEN 1 ELSE stddev_pop(x) END, 7) AS std FROM (SELECT dim, CASE dim WHEN 0 THEN n / 10.0::DOUBLE WHEN 1 THEN (n > 1)::INT WHEN 2 THEN (n > 3)::INT WHEN 3 THEN (n > 8)::INT WHEN 4 THEN (n > 20)::INT ELSE (n > 60)::INT END::DOUBLE AS x FROM p, f) GROUP BY dim"))
def a28_obs_stats(spark, sf_dir):
    out = learning.obs_stats(_points(spark, sf_dir))
    return out.select("dim", F.round("mean", 9).alias("mean"), F.round("std", 7).alias("std"))


@query(T.oracle("touches", POINTS + f""", c AS (SELECT *, first_value(CASE WHEN touchId % 6 = 2 THEN channel END IGNORE NULLS) OVER (PARTITION BY entityId ORDER BY ts, touchId ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS engaged FROM p)
    SELECT avg((touchId % 3 = arm)::INT) AS agreement, avg(({NEXT} > 60)::INT) AS reach, count(*) AS n, avg((['email', 'sms', 'push', 'voice', 'mail'][touchId % 5 + 1] = engaged)::INT) AS routed, count(engaged) AS credited FROM c"""))
def a29_policy_readout(spark, sf_dir):
    """Agreement, reach, and how often the policy's channel is the one on which the journey's next engagement comes."""
    t = learning.transitions(_points(spark, sf_dir), "entityId", "ts", 1, ["touchId"]).withColumn("policy", (F.col("touchId") % 3).cast("int"))
    channels = F.array(*map(F.lit, CHANNELS))
    points = T.touches(spark, sf_dir).withColumn("engaged", F.when(F.col("touchId") % 6 == 2, F.col("channel"))).withColumn("policyChannel", F.get(channels, (F.col("touchId") % 5).cast("int")))
    routed = learning.routes_to_engaged(points, "entityId", "ts", ["touchId"], "policyChannel", "engaged")
    return learning.policy_readout(t, "policy", 1).crossJoin(routed)  # one row each


@query(T.oracle("candidates", "b AS (SELECT entityId, evaluatedAt, arg_min(channel, (-score, channel)) AS channel FROM candidates WHERE eligible AND score IS NOT NULL GROUP BY ALL) SELECT channel, count(*) AS members, count(*) / sum(count(*)) OVER () AS share FROM b GROUP BY channel"))
def a30_channel_mix(spark, sf_dir):
    return learning.channel_mix(T.candidates(spark, sf_dir).where("eligible and score is not null"), BY)


@query(T.oracle("candidates", """SELECT entityId, evaluatedAt, actionId, channel, round(greatest(0.01, least(0.99, round(0.5 - least(0.30, days * 0.01) + least(0.20, tasks * 0.02) + CASE WHEN tasks >= 3 THEN 0.10 ELSE 0 END + CASE WHEN days >= 10 THEN 0.05 ELSE 0 END - least(0.20, (tasks % 3) * 0.05) + CASE channel WHEN 'email' THEN 0.05 WHEN 'sms' THEN -0.05 ELSE 0 END, 4))), 4)::DOUBLE AS heuristic
    FROM (SELECT *, substr(entityId, 4)::BIGINT % 40 AS days, substr(entityId, 4)::BIGINT % 7 AS tasks FROM candidates)"""))
def f12_m11_heuristic_score(spark, sf_dir):
    c = T.candidates(spark, sf_dir)
    n = F.substring("entityId", 4, 20).cast("long")
    days, tasks = n % 40, n % 7
    f = {"daysSinceLogin": days, "completedTasks": tasks, "usedChat": (tasks >= 3).cast("int"), "viewedDashboard": (days >= 10).cast("int"), "totalThisWeek": tasks % 3}
    return c.select(*BY, "actionId", "channel", F.round(learning.heuristic_score(f, F.col("channel")), 4).alias("heuristic"))


@query(T.oracle("candidates", """SELECT entityId, evaluatedAt, actionId, channel, round(CASE WHEN hardCompleted THEN b - 100 WHEN active OR coalesce(workflowState IN ('CREATED', 'IN_PROCESS', 'PRESENTED', 'SUPPRESSING'), false) THEN b - 50 WHEN softCompleted THEN b * 5 - 10
    WHEN coalesce(workflowState IN ('DECLINED', 'FAILED', 'EXPIRED'), false) THEN b * 3 - 20 ELSE b * 10 + 10 END, 9) AS band FROM (SELECT *, (('0x' || substr(md5(entityId || '|' || actionId || '|' || channel), 1, 8))::BIGINT / 4294967295::DOUBLE) AS b FROM candidates)"""))
def f17_journey_score(spark, sf_dir):
    c = T.candidates(spark, sf_dir)
    band = learning.journey_score(*(F.col(x) for x in ("entityId", "actionId", "channel", "hardCompleted", "active", "workflowState", "softCompleted")))
    return c.select(*BY, "actionId", "channel", F.round(band, 9).alias("band"))


PRIOR_SQL = """m AS (SELECT 'op-' || c_custkey AS entityId, (c_custkey % 30)::DOUBLE AS logins, (c_custkey % 70)::DOUBLE AS pages, (30 + c_custkey % 60)::DOUBLE AS age, (c_custkey % 4)::DOUBLE AS barrier FROM customer),
    s AS (SELECT m.*, coalesce(k, 0) AS k FROM m LEFT JOIN (SELECT entityId, count(*) AS k FROM touches GROUP BY ALL) USING (entityId)),
    u AS (SELECT entityId, k, greatest(0, least(1, (logins / 15.0::DOUBLE + pages / 40.0::DOUBLE) / 2.0::DOUBLE)) AS d, greatest(0, least(1, (age - 55.0::DOUBLE) / 30.0::DOUBLE)) AS o, (barrier >= 1)::INT AS b FROM s),
    a AS (SELECT entityId, k, unnest([{'c': 'email', 'v': 0.5 + 0.4 * d}, {'c': 'sms', 'v': 0.45 + 0.4 * d - 0.1 * o}, {'c': 'push', 'v': 0.35 + 0.4 * d - 0.15 * o}, {'c': 'voice', 'v': 0.35 + 0.45 * o}, {'c': 'mail', 'v': 0.3 + 0.4 * o + 0.3 * b}]) AS x FROM u),
    l AS (SELECT entityId, k, x.c AS channel, greatest(0, least(1, x.v)) AS v FROM a)"""


def _prior_members(spark, sf_dir):
    key = F.col("c_custkey")
    sent = T.touches(spark, sf_dir).groupBy("entityId").agg(F.count(F.lit(1)).alias("sends"))
    m = T.read(spark, sf_dir, "customer").select(T.entity(key).alias("entityId"), (key % 30).cast("double").alias("portalLogins30d"), (key % 70).cast("double").alias("pagesViewed30d"), (30 + key % 60).cast("double").alias("age"), (key % 4).cast("double").alias("sdohBarrier"))
    return m.join(sent, "entityId", "left").withColumn("sends", F.coalesce("sends", F.lit(0)))


@query(T.oracle("touches", PRIOR_SQL + " SELECT entityId, channel, round((v - avg(v) OVER (PARTITION BY entityId)) * 3 * 6 / (6 + k), 7) AS prior FROM l"))
def f13_channel_prior(spark, sf_dir):
    out = learning.channel_prior(_prior_members(spark, sf_dir), 6.0, 3.0)
    return out.withColumn("prior", F.round("prior", 7))


@query(T.oracle("candidates touches", """k AS (SELECT entityId, channel, count(*) AS nSent FROM touches WHERE channel IN ('email', 'voice') GROUP BY ALL), c AS (SELECT x.entityId, x.actionId, x.channel, x.score, coalesce(nSent, 0) AS nSent, x.score + 2.5 / (1.0::DOUBLE + coalesce(nSent, 0)) AS s FROM (SELECT entityId, actionId, channel, max(score) AS score FROM candidates WHERE eligible AND score IS NOT NULL GROUP BY ALL) x LEFT JOIN k USING (entityId, channel)),
    r AS (SELECT *, max(s) OVER (PARTITION BY entityId) AS best, dense_rank() OVER (PARTITION BY entityId, nSent = 0 ORDER BY s) AS rk FROM c) SELECT entityId, actionId, channel, nSent, round(CASE WHEN nSent = 0 THEN best + 8 + rk * 1e-6 ELSE s END, 9) AS explored FROM r"""))
def w7_m12_explore_bonus(spark, sf_dir):
    c = T.candidates(spark, sf_dir).where("eligible and score is not null").groupBy("entityId", "actionId", "channel").agg(F.max("score").alias("score"))
    sent = T.touches(spark, sf_dir).where("channel in ('email', 'voice')").groupBy("entityId", "channel").agg(F.count(F.lit(1)).alias("nSent"))
    return learning.explore_bonus(c, sent, 2.5, 8.0).select("entityId", "actionId", "channel", "nSent", F.round("explored", 9).alias("explored"))


@query(T.oracle("candidates", "SELECT entityId, evaluatedAt, actionId, channel, round(exp((score - max(score) OVER w) / 0.2) / sum(exp((score - m) / 0.2)) OVER w, 9) AS p FROM (SELECT *, max(score) OVER (PARTITION BY entityId, evaluatedAt) AS m FROM candidates WHERE score IS NOT NULL) WINDOW w AS (PARTITION BY entityId, evaluatedAt)"))
def f16_softmax(spark, sf_dir):
    from pyspark.sql import Window

    c = T.candidates(spark, sf_dir).where("score is not null")
    return softmax(c, "score", 0.2, Window.partitionBy(*BY), "p").select(*BY, "actionId", "channel", F.round("p", 9).alias("p"))


SCORES = [f"(('0x' || substr(md5('m{k}|' || entityId || '|' || actionId || '|' || channel), 1, 8))::BIGINT / 4294967295::DOUBLE)" for k in range(5)]


@query(T.oracle("candidates", f"""s AS (SELECT entityId, evaluatedAt, actionId, channel, unnest([{', '.join(SCORES)}]) AS s, unnest(range(5)) AS model FROM candidates WHERE eligible), r AS (SELECT *, (row_number() OVER (PARTITION BY entityId, evaluatedAt, model ORDER BY s DESC, actionId, channel) = 1)::INT AS vote FROM s)
    SELECT entityId, evaluatedAt, actionId, channel, sum(vote) / 5 AS propensity FROM r GROUP BY ALL"""))
def w14_m8_vote_propensity(spark, sf_dir):
    from tidemark.functions.scalars import stable01

    c = T.candidates(spark, sf_dir).where("eligible")
    scores = F.array(*[stable01(F.lit(f"m{k}"), F.col("entityId"), F.col("actionId"), F.col("channel")) for k in range(5)])
    return learning.thompson(c.withColumn("scores", scores), 5, BY, "seed").select(*BY, "actionId", "channel", "propensity")


@query(T.oracle("candidates", "SELECT entityId, evaluatedAt, actionId, channel, (('0x' || substr(md5('s1|' || entityId || '|' || actionId || '|' || channel), 1, 8))::BIGINT / 4294967295::DOUBLE) AS explore FROM candidates WHERE eligible"))
def m9_explore_score(spark, sf_dir):
    return learning.explore_score(T.candidates(spark, sf_dir), "s1").select(*BY, "actionId", "channel", "explore")


#: CRC-32 of a text of ASCII letters, bit by bit: reflected, polynomial 0xEDB88320.
CRC32_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"


@query(T.oracle("candidates", f"""w AS (SELECT entityId, {CRC32_SQL.format('entityId')} % 5 AS j FROM (SELECT DISTINCT entityId FROM candidates)),
    a AS (SELECT c.*, CASE WHEN n % 5 = j THEN n // 5 END AS step FROM (SELECT *, substr(actionId, 8)::INT AS n FROM candidates) c JOIN w USING (entityId)),
    f AS (SELECT entityId, evaluatedAt, min({{'step': step, 'channel': channel}}) FILTER (eligible AND step IS NOT NULL) AS own, min({{'actionId': actionId, 'channel': channel}}) FILTER (eligible) AS other FROM a GROUP BY ALL)
    SELECT a.entityId, a.evaluatedAt, a.actionId, a.channel, (eligible AND CASE WHEN own IS NULL THEN a.actionId = other.actionId AND a.channel = other.channel ELSE coalesce(step = own.step AND a.channel = own.channel, false) END)::INT AS playbook FROM a JOIN f ON f.entityId = a.entityId AND f.evaluatedAt = a.evaluatedAt"""))
def m10_f15_playbook_score(spark, sf_dir):
    c = T.candidates(spark, sf_dir)
    n = F.substring_index("actionId", "_", -1).cast("int")
    journeys = c.select("actionId").distinct().select((n % 5).alias("journey"), F.floor(n / 5).cast("int").alias("step"), "actionId")
    return learning.playbook_score(c, journeys, BY).select(*BY, "actionId", "channel", "playbook")


@query(T.oracle("facts_profile", """f AS (SELECT entityId, max(CASE WHEN key LIKE '%isDNC' AND value = 'true' THEN 1.0 ELSE 0.0 END) AS d, max(CASE WHEN key LIKE '%smsConsent' AND value = 'true' THEN 1.0 ELSE 0.0 END) AS s, max(CASE WHEN key LIKE '%balance' THEN value::DOUBLE END) / 1000 AS b FROM facts_profile GROUP BY ALL),
    h AS (SELECT entityId, (d - 0.1) / 0.5 AS x0, (s - 0.8) / 0.5 AS x1, (b - 4) / 3 AS x2 FROM f), y AS (SELECT entityId, greatest(0, x0 - x1 + 0.1) AS h0, greatest(0, 0.5 * x2 + 0.2) AS h1 FROM h)
    SELECT entityId, round((h0 - h1)::DOUBLE, 10) AS hold, round((0.5 * h0 + 0.25 * h1 + 0.3)::DOUBLE, 10) AS email FROM y"""))
def m7_qnet_score(spark, sf_dir):
    p = pivot_features(T.facts_profile(spark, sf_dir), "entityId", FEATURES)
    artifact = {"obs_mean": [0.1, 0.8, 4.0], "obs_std": [0.5, 0.5, 3.0], "layers": [{"W": [[1.0, 0.0], [-1.0, 0.0], [0.0, 0.5]], "b": [0.1, 0.2]}, {"W": [[1.0, 0.5], [-1.0, 0.25]], "b": [0.0, 0.3]}]}
    scored = learning.qnet_score(p.withColumn("obs", F.array("isDNC", "smsConsent", F.col("balance") / 1000)), artifact)
    return scored.select("entityId", F.round(F.get("q", F.lit(0)), 10).alias("hold"), F.round(F.get("q", F.lit(1)), 10).alias("email"))


ARMS = {"arms": [{"actionId": "action_1", "channel": "email"}, {"actionId": "action_2", "channel": "email"}, {"actionId": "action_1", "channel": "sms"}, {"actionId": "action_3", "channel": "push"}], "noop_index": 4}


@query(T.oracle("candidates", """o AS (SELECT *, substr(entityId, 4)::BIGINT AS k FROM candidates WHERE eligible AND NOT hardCompleted AND channel IN ('email', 'sms', 'push')),
    a AS (SELECT entityId, evaluatedAt, actionId, channel, k, CASE WHEN channel = 'email' AND actionId = 'action_2' THEN 1 WHEN channel = 'email' THEN 0 WHEN channel = 'sms' THEN 2 ELSE 3 END AS arm FROM o),
    s AS (SELECT entityId, evaluatedAt, actionId, channel, CASE WHEN k % 10 = 0 THEN 0 ELSE ((k * (arm + 3)) % 17) / 16.0::DOUBLE END AS score FROM a UNION ALL SELECT DISTINCT entityId, evaluatedAt, '__hold', 'hold', ((k * 7) % 17) / 16.0::DOUBLE FROM o WHERE k % 10 <> 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY entityId, evaluatedAt ORDER BY score DESC, actionId, channel) AS place FROM s) SELECT entityId, evaluatedAt, actionId, channel, score FROM r WHERE place = 1"""))
def m7_arm_lookup(spark, sf_dir):
    """The chosen arm of each evaluation: own arm, first arm of the channel, or holding; every tenth member has no values."""
    c = T.candidates(spark, sf_dir)
    k = F.substring("entityId", 4, 20).cast("long")
    q = F.array(*[(k * (i + 3) % 17) / F.lit(16.0) for i in range(5)])
    values = c.where(k % 10 != 0).select(*BY).distinct().withColumn("q", q)
    return learning.chosen_arm(learning.arm_scores(c, values, ARMS, BY), BY)


@query(T.oracle("touches", POINTS + """, m AS (SELECT entityId, touchId, arm, touchId % 3 AS policy, mode(arm) OVER (PARTITION BY n > 8) AS cloned FROM p), a AS (SELECT avg((policy = arm)::INT) AS agreement, avg((cloned = arm)::INT) AS "cloneAgreement" FROM m)
    SELECT "cloneAgreement" >= 0.12 AND agreement >= 0.75 * "cloneAgreement" AND agreement >= 0.12 AS promote, round(0.75 * "cloneAgreement", 9) AS bar, agreement, "cloneAgreement" FROM a""".replace("mode(arm) OVER (PARTITION BY n > 8)", "CASE WHEN n > 8 THEN -1 ELSE 0 END")))
def m14_clone_gate(spark, sf_dir):
    """Whether a policy repeats the logged arms nearly as well as a clone that knows only whether a journey is long."""
    p = _points(spark, sf_dir)
    cloned = F.when(F.get("obs", F.lit(3)) >= 1, -1).otherwise(0)
    same = lambda c: F.avg((c == F.col("arm")).cast("int"))
    readout = p.agg(same(F.col("touchId") % 3).alias("agreement"), same(cloned).alias("cloneAgreement"))
    return learning.clone_gate(readout).withColumn("bar", F.round("bar", 9))


@query(T.oracle("sends", EXAMPLES + """, v AS (SELECT channel IN ('email', 'sms') AS champ, sum(label / greatest(propensity, 0.05)) / sum(1 / greatest(propensity, 0.05)) AS value FROM x GROUP BY ALL)
    SELECT (SELECT value FROM v WHERE NOT champ) - (SELECT value FROM v WHERE champ) >= 0.01 AS promote, 'snips' AS why, round((SELECT value FROM v WHERE NOT champ) - (SELECT value FROM v WHERE champ), 9) AS gain"""))
def m14_promotion_gate(spark, sf_dir):
    x = examples(spark, sf_dir)
    value = lambda df, model: learning.snips(df).select(F.lit(model).alias("model"), F.lit("snips").alias("metric"), "value")
    metrics = value(x.where("channel in ('email', 'sms')"), "champion").unionByName(value(x.where("channel not in ('email', 'sms')"), "challenger"))
    return learning.promotion_gate(metrics, 0.01).withColumn("gain", F.round("gain", 9))


@query()
def m5_propensity_ensemble(spark, sf_dir):
    """No SQL: boosted trees. A test checks that the ensemble ranks better than chance."""
    from pyspark.ml.feature import VectorAssembler

    x = examples(spark, sf_dir).withColumns({"hour": (F.col("decisionTs") / DAY % 7).cast("double"), "load": F.substring("correlationId", 3, 20).cast("double") % 9, "source": F.lit("real")})
    models = learning.train_propensity(x, ["hour", "load"], models=2, trees=3)
    out = VectorAssembler(inputCols=["hour", "load"], outputCol="features").transform(x)
    for k, m in enumerate(models):
        out = m.transform(out).withColumn(f"p{k}", F.element_at(_second("probability"), 1)).drop("rawPrediction", "probability", "prediction")
    return out.select("correlationId", "label", ((F.col("p0") + F.col("p1")) / 2).alias("score"))


def _second(column):
    from pyspark.ml.functions import vector_to_array

    return F.slice(vector_to_array(F.col(column)), 2, 1)


@query()
def m6_behaviour_clone(spark, sf_dir):
    """No SQL: a trained network. A test checks that it repeats a policy that depends on the observation."""
    from pyspark.ml.functions import array_to_vector

    p = _points(spark, sf_dir).withColumn("arm", (F.get("obs", F.lit(3)) >= 1).cast("int"))
    model = learning.behaviour_clone(p, 2)
    return model.transform(p.withColumn("features", array_to_vector("obs"))).select("touchId", "arm", F.col("prediction").cast("int").alias("cloned"))



FEATURE_SQL = "f AS (SELECT entityId, max(CASE WHEN key LIKE '%isDNC' THEN (value = 'true')::INT END)::DOUBLE AS isDNC, max(CASE WHEN key LIKE '%smsConsent' THEN (value = 'true')::INT END)::DOUBLE AS smsConsent, max(CASE WHEN key LIKE '%balance' THEN value::DOUBLE END) AS balance FROM facts_profile GROUP BY ALL)"


@query(T.oracle("facts_profile", FEATURE_SQL + " SELECT entityId, isDNC, smsConsent, balance, 0.0::DOUBLE AS segment FROM f"))
def m1_parse_features(spark, sf_dir):
    from tidemark.operators.sequences import fold_snapshots
    from tidemark.operators.serving import parse_features

    s = fold_snapshots(T.facts_profile(spark, sf_dir), ["entityId"])
    return s.select("entityId", *(c.alias(n) for n, c in parse_features(F.col("factsJson"), FEATURES).items()))


@query("""WITH m AS (SELECT c_custkey, (c_custkey % 2)::DOUBLE AS r, (c_custkey % 3 = 0)::INT::DOUBLE AS g, (c_custkey % 5 = 0)::INT::DOUBLE AS h, (c_custkey % 25)::DOUBLE AS w FROM customer)
    SELECT c_custkey, r + g + h + (g * h) + least(w, 18) / 18 + r + g + h + w AS total, 4 + 2 + 5 + 1 AS width FROM m""")
def p32_build_obs(spark, sf_dir):
    key = F.col("c_custkey")
    base = {"respondedToOutreach": key % 2, "registeredForPortal": (key % 3 == 0).cast("int"), "hraCompleted": (key % 5 == 0).cast("int"), "totalThisWeek": key % 25}
    pair = (key % 15 == 0).cast("int")
    rest = {"pcpSelected": pair, "careTeamEngaged": pair, "awvCompleted": F.lit(0), "medAdherent": F.lit(0), "mammogramDone": F.lit(0), "opened_email": F.lit(0), "ignored_email": F.lit(0)}
    c = T.read(spark, sf_dir, "customer").select("c_custkey", *(v.cast("double").alias(n) for n, v in {**base, **rest}.items()))
    obs = learning.build_obs(c, list(base), ["opened_email", "ignored_email"], "totalThisWeek")
    return obs.select("c_custkey", F.aggregate("obs", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("obs").alias("width"))


@query(T.oracle("facts_events facts_profile", rules_plan.MEMBERS + """, h AS (SELECT entityId, 'action_1' AS actionId, 'email' AS channel FROM g WHERE NOT dnc UNION ALL SELECT entityId, 'action_1', 'sms' FROM g WHERE NOT dnc AND consent
        UNION ALL SELECT entityId, 'action_2', 'sms' FROM g WHERE NOT dnc AND browsing AND errors <= 8 AND consent UNION ALL SELECT entityId, 'action_2', 'push' FROM g WHERE NOT dnc AND browsing AND errors <= 8 UNION ALL SELECT entityId, 'action_3', 'mail' FROM g WHERE NOT dnc),
    s AS (SELECT *, (('0x' || substr(md5(entityId || '|' || actionId || '|' || channel), 1, 8))::BIGINT / 4294967295::DOUBLE) AS score FROM h)
    SELECT entityId, actionId, channel, place FROM (SELECT *, row_number() OVER (PARTITION BY entityId ORDER BY score DESC, actionId, channel) AS place FROM s) WHERE place <= 2"""))
def m15_m16_decide(spark, sf_dir):
    from tidemark.operators.serving import decide

    gold = T.facts_events(spark, sf_dir).unionByName(T.facts_profile(spark, sf_dir))
    asked = T.facts_profile(spark, sf_dir).select("entityId").distinct()
    request = asked.select("entityId", F.lit("operator.activity.purchase").alias("key"), F.lit("99").alias("value"), F.lit(T.NOW_MS).alias("eventTs"))
    scorer = lambda df: df.withColumn("score", stable01(F.col("entityId"), F.col("actionId"), F.col("channel")))
    return decide(request, gold, rules_plan.DEFS, scorer, 2).select("entityId", "actionId", "channel", "place")


@query(T.oracle("facts_events facts_profile fact_history", rules_plan.MEMBERS + f""", w AS (SELECT entityId, count(*) AS n FROM (SELECT DISTINCT entityId, key, eventTs FROM fact_history WHERE key LIKE 'nba.actionstate.%' AND value = 'IN_PROCESS' AND eventTs > {T.NOW_MS - 7 * DAY} AND eventTs <= {T.NOW_MS}) GROUP BY entityId),
    x AS (SELECT g.* FROM g LEFT JOIN w USING (entityId) WHERE NOT dnc AND coalesce(n, 0) < 4),
    h AS (SELECT entityId, 'action_1' AS actionId, 'email' AS channel FROM x WHERE purchase > 10 UNION ALL SELECT entityId, 'action_1', 'sms' FROM x WHERE purchase > 10 AND consent
        UNION ALL SELECT entityId, 'action_2', 'sms' FROM x WHERE browsing AND errors <= 8 AND consent AND NOT bought UNION ALL SELECT entityId, 'action_2', 'push' FROM x WHERE browsing AND errors <= 8 AND NOT bought UNION ALL SELECT entityId, 'action_3', 'mail' FROM x)
    SELECT entityId, actionId, channel, (('0x' || substr(md5(entityId || '|' || actionId || '|' || channel), 1, 8))::BIGINT / 4294967295::DOUBLE) AS score FROM h""".replace("SELECT g.* FROM g", "SELECT g.*, purchase >= 1 AS bought FROM g")))
def m16_rescore_all(spark, sf_dir):
    """Everyone who may be contacted: list, weekly cap, consent, and an action that a purchase achieves."""
    from tidemark.operators.reports import comms_counts
    from tidemark.operators.serving import rescore_all

    states = T.fact_history(spark, sf_dir).where("key like 'nba.actionstate.%'").withColumn("channel", F.split_part("key", F.lit("."), F.lit(4))).withColumn("actionId", F.split_part("key", F.lit("."), F.lit(3)))
    week = comms_counts(states, T.NOW_MS, 7 * DAY, "IN_PROCESS").where("key = 'operator.comms.totalThisWeek'").select("entityId", "key", F.col("n").cast("string").alias("value"), F.lit(T.NOW_MS).alias("eventTs"))
    facts = T.facts_events(spark, sf_dir).unionByName(T.facts_profile(spark, sf_dir)).select("entityId", "key", "value", "eventTs").unionByName(week)
    scorer = lambda df: df.withColumn("score", stable01(F.col("entityId"), F.col("actionId"), F.col("channel")))
    return rescore_all(member_fact_map(facts), rules_plan.DEFS, scorer, 4, {"action_2": "operator.activity.purchase"}).select("entityId", "actionId", "channel", "score")


@query(T.oracle("candidates", "SELECT entityId AS nbaId, actionId, channel, correlationId, score AS base_score, score + 0.5 AS emit_score, 0.25::DOUBLE AS propensity, 0.3::DOUBLE AS temperature, evaluatedAt FROM candidates WHERE eligible"))
def m13_log_predictions(spark, sf_dir):
    from tidemark.operators.serving import log_predictions

    c = T.candidates(spark, sf_dir).where("eligible").withColumns({"emit": F.col("score") + 0.5, "propensity": F.lit(0.25)})
    return log_predictions(c, 0.3, T.NOW_MS).drop("scoredAt")


@query(T.oracle("touches fact_history", "SELECT key || ' = ' || value AS line FROM fact_history WHERE key LIKE 'nba.score.%' UNION ALL SELECT 'CREATE ' || actionId FROM touches"))
def p34_summaries(spark, sf_dir):
    from tidemark.operators.serving import summarize

    none = F.lit(None).cast("string")
    f = T.fact_history(spark, sf_dir).where("key like 'nba.score.%'")
    facts = f.select(summarize(F.lit("nba.member.facts"), {"op": none, "name": none, "key": F.col("key"), "value": F.col("value"), "n": F.lit(0)}).alias("line"))
    acts = T.touches(spark, sf_dir).select(summarize(F.lit("nba.activations"), {"op": F.lit("CREATE"), "name": F.col("actionId"), "key": none, "value": none, "n": F.lit(0)}).alias("line"))
    return facts.unionByName(acts)
