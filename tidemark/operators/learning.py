"""Training sets, policies and their evaluation, as columns and aggregates; models are Spark ML or Arrow batches."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import stable01
from tidemark.operators.joining import asof_features, attach_propensity, episode_states
from tidemark.operators.selection import value_at, with_prefix
from tidemark.operators.sequences import days_since_contact, trailing_counts

# Milestones of a journey, the features that each needs, and its reward; a contact's cost; the longest journey.
MILESTONES = [
    ("reached", ["respondedToOutreach"], 1.0),
    ("registered", ["registeredForPortal"], 2.0),
    ("assessed", ["hraCompleted"], 4.0),
    ("engaged", ["pcpSelected", "careTeamEngaged"], 8.0),
    ("stars", ["awvCompleted", "medAdherent", "mammogramDone"], 20.0),
]
SEND_COST, MAX_STEPS = 0.15, 18

# States that label an episode as answered; a hard completion is the positive label.
ANSWERED = ("PRESENTED", "SOFT_COMPLETED", "DECLINED")


def episode_label(states: Column) -> Column:
    """1 for a set of states with HARD_COMPLETED, 0 for one with an answer, else null (no label)."""
    return F.when(F.array_contains(states, "HARD_COMPLETED"), 1).when(F.arrays_overlap(states, F.array(*map(F.lit, ANSWERED))), 0)


def training_set(sends: DataFrame, states: DataFrame, snapshots: DataFrame, log: DataFrame, days: int = 14) -> DataFrame:
    """One labelled example for each contact with a prior snapshot: context counts, point-in-time features, propensity.

    ``snapshots``: entityId, snapTs, features...; ``log``: entityId, actionId, propensity.
    """
    by = ["entityId", "actionId", "channel"]
    labelled = episode_states(sends, states, by).groupBy(*by, "decisionTs", "correlationId").agg(F.collect_set("state").alias("states"))
    labelled = labelled.withColumn("label", episode_label(F.col("states"))).where("label is not null").drop("states")
    context = trailing_counts(sends, "decisionTs", days, {"thisChannelRecentN": ["entityId", "channel"], "thisActionRecentN": ["entityId", "actionId"]})
    context = days_since_contact(context, ["entityId"], "decisionTs", days, float(days)).select("correlationId", "thisChannelRecentN", "thisActionRecentN", "daysSinceLastContact")
    features = [c for c in snapshots.columns if c not in ("entityId", "snapTs")]
    joined = asof_features(labelled.join(context, "correlationId"), snapshots, ["entityId"], "decisionTs", "snapTs", features)
    return attach_propensity(joined, log, ["entityId", "actionId"])


def milestone_flags() -> list[Column]:
    """1 or 0 for each milestone, over the feature columns."""
    flags = []
    for _, needs, _ in MILESTONES:
        held = F.lit(True)
        for f in needs:
            held = held & (F.col(f) >= 1)
        flags.append(held.cast("double"))
    return flags


def build_obs(df: DataFrame, features: list[str], engagement: list[str], contacts: str) -> DataFrame:
    """Adds obs: features, engagement flags, milestone flags and the share of the longest journey, in this order."""
    step = F.least(F.greatest(F.col(contacts), F.lit(0.0)), F.lit(float(MAX_STEPS))) / MAX_STEPS
    return df.withColumn("obs", F.array(*(F.col(c).cast("double") for c in [*features, *engagement]), *milestone_flags(), step))


def transitions(points: DataFrame, by: str, ts: str, first_milestone: int, ties: list[str]) -> DataFrame:
    """Adds next_obs, reward, done in each member's order: reward is the value of milestones newly reached less the cost of a
    contact; the last point, or one that reaches the last milestone, is done and keeps its own observation."""
    order = Window.partitionBy(by).orderBy(ts, *ties)
    following = F.coalesce(F.lead("obs").over(order), F.col("obs"))
    out = points.withColumn("next_obs", following).withColumn("_last", F.lead(ts).over(order).isNull())
    gained = sum((F.lit(v) * F.greatest(F.lit(0.0), F.get("next_obs", F.lit(first_milestone + i)) - F.get("obs", F.lit(first_milestone + i))) for i, (_, _, v) in enumerate(MILESTONES)), F.lit(0.0))
    ended = F.col("_last") | (F.get("next_obs", F.lit(first_milestone + len(MILESTONES) - 1)) >= 1)
    return out.withColumn("reward", gained - F.when(F.col("arm") >= 0, SEND_COST).otherwise(0.0)).withColumn("done", ended.cast("double")).drop("_last")


def arm_posteriors(examples: DataFrame) -> DataFrame:
    """Beta posteriors of each (action, channel): alpha = 1 + successes, beta = 1 + failures."""
    sums = examples.groupBy("actionId", "channel").agg(F.sum("label").alias("s"), F.count("label").alias("n"))
    return sums.select("actionId", "channel", "n", (1 + F.col("s")).alias("alpha"), (1 + F.col("n") - F.col("s")).alias("beta"), ((1 + F.col("s")) / (2 + F.col("n"))).alias("mean"))


def snips(examples: DataFrame, score: str | None = None) -> DataFrame:
    """One row, value: self-normalised inverse propensity estimate; with ``score`` over the better half by that score."""
    if score is not None:
        examples = examples.where(F.col(score) >= F.lit(value_at(examples, score, 0.5)))
    weight = 1 / F.least(F.greatest("propensity", F.lit(0.05)), F.lit(1.0))
    return examples.agg((F.sum(weight * F.col("label")) / F.sum(weight)).alias("value"), F.count(F.lit(1)).alias("n"))


def anneal_temperature(n: Column) -> Column:
    """Exploration falls from .30 to .03 with the number of real examples."""
    return F.greatest(F.lit(0.03), F.least(F.lit(0.30), 0.30 * F.exp(-n / F.lit(20000.0))))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row, auc by rank sums: each distinct score's negatives are counted, and summed up by ranges of scores."""
    per = df.groupBy(score).agg(F.sum(label).alias("pos"), (F.count(label) - F.sum(label)).alias("neg"))
    won = with_prefix(per, score, "neg", "below").withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return won.agg((F.sum("won") / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def obs_stats(trans: DataFrame, obs: str = "obs") -> DataFrame:
    """dim, mean, std (population; 1 where it is 0) of each dimension."""
    each = trans.select(F.posexplode(obs).alias("dim", "x"))
    stats = each.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return stats.withColumn("std", F.when(F.col("std") < 1e-9, 1.0).otherwise(F.col("std")))


def shape_reward(trans: DataFrame, first_milestone: int, gamma: float = 0.97, scale: float = 0.1) -> DataFrame:
    """Adds shaped: (reward + gamma * potential(next) - potential(now)) * scale, the potential being the value of held milestones."""
    def potential(obs: str) -> Column:
        return sum((F.lit(v) * F.get(obs, F.lit(first_milestone + i)) for i, (_, _, v) in enumerate(MILESTONES)), F.lit(0.0))

    return trans.withColumn("shaped", (F.col("reward") + gamma * potential("next_obs") * (1 - F.col("done")) - potential("obs")) * scale)


def policy_readout(trans: DataFrame, policy_arm: str, first_milestone: int) -> DataFrame:
    """One row: agreement of the policy with the logged arm, share of journeys that reach the last milestone, n."""
    reached = F.get("next_obs", F.lit(first_milestone + len(MILESTONES) - 1)) >= 1
    return trans.agg(F.avg((F.col(policy_arm) == F.col("arm")).cast("int")).alias("agreement"), F.avg(reached.cast("int")).alias("reach"), F.count(F.lit(1)).alias("n"))


def routes_to_engaged(points: DataFrame, by: str, ts: str, ties: list[str], policy_channel: str, engaged: str) -> DataFrame:
    """One row, routed and credited: of the decision points that lead to an engagement, the share that the policy sends there.

    ``engaged``: the channel on which the member engaged at a point, or null. An engagement is credited backwards along the journey, to every point up
    to it and after the one before: a reverse window takes the first engagement at or after a point. Points with none ahead do not count.
    """
    ahead = Window.partitionBy(by).orderBy(ts, *ties).rowsBetween(0, Window.unboundedFollowing)
    credited = points.withColumn("_to", F.first(engaged, ignorenulls=True).over(ahead)).where("_to is not null")
    return credited.agg(F.avg(F.coalesce(F.col(policy_channel) == F.col("_to"), F.lit(False)).cast("int")).alias("routed"), F.count(F.lit(1)).alias("credited"))


def channel_mix(scored: DataFrame, by: list[str]) -> DataFrame:
    """channel, members, share of the population whose best channel it is."""
    best = scored.groupBy(*by).agg(F.min_by("channel", F.struct((-F.col("score")).alias("s"), "channel")).alias("channel"))
    counts = best.groupBy("channel").agg(F.count(F.lit(1)).alias("members"))
    return counts.withColumn("share", F.col("members") / F.sum("members").over(Window.partitionBy()))


def heuristic_score(f: dict[str, Column], channel: Column) -> Column:
    """The rule-of-thumb propensity: recency, tasks, chat, dashboard and contact load move 0.5, within .01 and .99, 4 decimals."""
    s = 0.5 - F.least(F.lit(0.30), f["daysSinceLogin"] * 0.01) + F.least(F.lit(0.20), f["completedTasks"] * 0.02)
    s = s + F.when(f["usedChat"] >= 1, 0.10).otherwise(0.0) + F.when(f["viewedDashboard"] >= 1, 0.05).otherwise(0.0)
    s = s - F.least(F.lit(0.20), f["totalThisWeek"] * 0.05) + F.when(channel == "email", 0.05).when(channel == "sms", -0.05).otherwise(0.0)
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.round(s, 4)))


def journey_score(member: Column, action: Column, channel: Column, hard: Column, active: Column, state: Column, soft: Column) -> Column:
    """Scripted bands: fresh contacts on top, then engaged, set back, under way and completed ones, spread by a stable number."""
    b = stable01(member, action, channel)
    busy = active | F.coalesce(state.isin("CREATED", "IN_PROCESS", "PRESENTED", "SUPPRESSING"), F.lit(False))
    negative = F.coalesce(state.isin("DECLINED", "FAILED", "EXPIRED"), F.lit(False))
    return F.when(hard, b - 100.0).when(busy, b - 50.0).when(soft, b * 5.0 - 10.0).when(negative, b * 3.0 - 20.0).otherwise(b * 10.0 + 10.0)


def channel_prior(members: DataFrame, weight: float, gain: float) -> DataFrame:
    """entityId, channel, prior: a member's leaning by age, digital use and barriers, centred, fading with the contacts made.

    ``members``: entityId, portalLogins30d, pagesViewed30d, age, sdohBarrier, sends.
    """
    def unit(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    digital = unit((F.col("portalLogins30d") / 15.0 + F.col("pagesViewed30d") / 40.0) / 2.0)
    old = unit((F.col("age") - 55.0) / 30.0)
    barrier = (F.col("sdohBarrier") >= 1).cast("double")
    leaning = {
        "email": 0.50 + 0.40 * digital, "sms": 0.45 + 0.40 * digital - 0.10 * old, "push": 0.35 + 0.40 * digital - 0.15 * old,
        "voice": 0.35 + 0.45 * old, "mail": 0.30 + 0.40 * old + 0.30 * barrier,
    }
    each = F.array(*[F.struct(F.lit(c).alias("channel"), unit(v).alias("a")) for c, v in leaning.items()])
    mean = F.aggregate("each", F.lit(0.0), lambda acc, x: acc + x["a"]) / len(leaning)
    rows = members.withColumn("each", each).withColumn("mean", mean).select("entityId", "sends", "mean", F.explode("each").alias("e"))
    return rows.select("entityId", F.col("e.channel").alias("channel"), ((F.col("e.a") - F.col("mean")) * gain * weight / (weight + F.col("sends"))).alias("prior"))


def explore_bonus(candidates: DataFrame, sent: DataFrame, explore: float, first_try: float) -> DataFrame:
    """Adds nSent and explored: the score plus a bonus that falls with the contacts made; channels never tried come first, best first.

    ``sent``: entityId, channel, nSent. Untried arms are lifted above the member's best score, in the order of their own.
    """
    c = candidates.join(sent, ["entityId", "channel"], "left").withColumn("nSent", F.coalesce("nSent", F.lit(0)))
    c = c.withColumn("_s", F.col("score") + explore / (1.0 + F.col("nSent")))
    member = Window.partitionBy("entityId")
    fresh = F.col("nSent") == 0
    rank = F.dense_rank().over(Window.partitionBy("entityId", fresh).orderBy("_s"))
    lifted = F.max("_s").over(member) + first_try + rank * 1e-6
    return c.withColumn("explored", F.when(fresh, lifted).otherwise(F.col("_s"))).drop("_s")


def playbook_score(candidates: DataFrame, journeys: DataFrame, by: list[str]) -> DataFrame:
    """Adds playbook: 1 for the first eligible step of the member's journey, 0 for all others.

    ``journeys``: journey, step, actionId. A member's journey is a CRC-32 bucket of the id. A member none of whose steps is
    eligible is kept moving by its first eligible contact off the journey, in the order of action and channel.
    """
    n = journeys.agg(F.count_distinct("journey").alias("n"))
    own = candidates.crossJoin(F.broadcast(n)).withColumn("journey", (F.crc32(F.col("entityId").cast("binary")) % F.col("n")).cast("int")).drop("n")
    placed = own.join(journeys, ["journey", "actionId"], "left")
    first = F.min(F.when(F.col("eligible") & F.col("step").isNotNull(), F.struct("step", "channel"))).over(Window.partitionBy(*by))
    other = F.min(F.when(F.col("eligible"), F.struct("actionId", "channel"))).over(Window.partitionBy(*by))
    on_journey = (F.col("step") == first["step"]) & (F.col("channel") == first["channel"])
    off_journey = (F.col("actionId") == other["actionId"]) & (F.col("channel") == other["channel"])
    hit = F.col("eligible") & F.when(first.isNotNull(), on_journey).otherwise(off_journey)
    return placed.withColumn("playbook", F.coalesce(hit, F.lit(False)).cast("int")).drop("journey", "step")


def explore_score(candidates: DataFrame, seed: str) -> DataFrame:
    """Adds explore: a uniform score for each eligible arm that reruns agree on."""
    return candidates.where("eligible").withColumn("explore", stable01(F.lit(seed), F.col("entityId"), F.col("actionId"), F.col("channel")))


def thompson(scored: DataFrame, models: int, by: list[str], seed: str) -> DataFrame:
    """``scored`` has an array ``scores`` of one score for each model. Each evaluation is decided by the model that its hash draws.

    Adds emit (the drawn model's score, the winner's raised by 1e-4) and propensity (the share of models whose winner the arm is).
    """
    rows = scored.select("*", F.posexplode("scores").alias("model", "s"))
    best = Window.partitionBy(*by, "model").orderBy(F.desc("s"), "actionId", "channel")
    voted = rows.withColumn("vote", (F.row_number().over(best) == 1).cast("int"))
    drawn = F.pmod(F.crc32(F.concat_ws("|", F.lit(seed), *by).cast("binary")), F.lit(models))
    out = voted.groupBy(*by, "actionId", "channel").agg((F.sum("vote") / models).alias("propensity"), F.max(F.when(F.col("model") == drawn, F.col("s") + F.col("vote") * 1e-4)).alias("emit"))
    return out


def qnet_score(df: DataFrame, artifact: dict, obs: str = "obs") -> DataFrame:
    """Adds q (array of one value for each arm): a small network on normalised observations, in Arrow batches.

    ``artifact``: obs_mean, obs_std and layers of W (in x out) and b, ReLU between layers.
    """
    shared = df.sparkSession.sparkContext.broadcast(json.loads(json.dumps(artifact)))

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        a = shared.value
        x = (np.stack(rows.to_numpy()) - np.array(a["obs_mean"])) / np.array(a["obs_std"]) if len(rows) else np.zeros((0, len(a["obs_mean"])))
        for i, layer in enumerate(a["layers"]):
            x = x @ np.array(layer["W"]) + np.array(layer["b"])
            if i + 1 < len(a["layers"]):
                x = np.maximum(x, 0)
        return pd.Series(list(x))

    return df.withColumn("q", run(F.col(obs)))


HOLD = "__hold"


def arm_scores(candidates: DataFrame, values: DataFrame, artifact: dict, by: list[str]) -> DataFrame:
    """Candidates (``by``, actionId, channel, eligible, hardCompleted) with score, and a row for holding back.

    ``values``: ``by`` and q, one value for each arm and the last for holding. A candidate has its own arm's value; one that the network does not
    know takes the first arm of its channel; ineligible and completed ones, and channels without any arm, are masked out. Members
    without values score 0 and cannot hold. Arms are what people author; a member's values stay one array.
    """
    arms = artifact["arms"]
    own = {(a["actionId"], a["channel"]): i for i, a in reversed(list(enumerate(arms)))}
    first = {a["channel"]: i for i, a in reversed(list(enumerate(arms)))}
    spark = candidates.sparkSession
    known = F.broadcast(spark.createDataFrame([(*k, i) for k, i in own.items()], "actionId string, channel string, _own int"))
    fallback = F.broadcast(spark.createDataFrame(list(first.items()), "channel string, _first int"))
    open_ = candidates.where("eligible and not hardCompleted").join(fallback, "channel").join(known, ["actionId", "channel"], "left").join(values.select(*by, "q"), by, "left")
    scored = open_.withColumn("score", F.coalesce(F.get("q", F.coalesce("_own", "_first")), F.lit(0.0)))
    hold = open_.where("q is not null").groupBy(*by).agg(F.any_value("q").alias("q"))
    held = hold.select(*by, F.lit(HOLD).alias("actionId"), F.lit("hold").alias("channel"), F.get("q", F.lit(artifact["noop_index"])).alias("score"))
    return scored.select(*by, "actionId", "channel", "score").unionByName(held)


def chosen_arm(scored: DataFrame, by: list[str]) -> DataFrame:
    """``by``, actionId, channel, score of the best arm: higher scores first, then smaller names; a null score is never the best of others."""
    best = F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("s"), "actionId", "channel", "score")
    return scored.groupBy(*by).agg(F.min(best).alias("b")).select(*by, "b.actionId", "b.channel", "b.score")


def bootstrap_weight(key: Column, model: int) -> Column:
    """A Poisson(1) weight by inverse transform of a stable number: bootstrap resampling without drawing."""
    u = stable01(key, F.lit(f"boot{model}"))
    steps, total, term = [], 0.0, math.exp(-1)
    for k in range(8):
        total += term
        term /= k + 1
        steps.append((total, k))
    weight = F.lit(8)
    for bound, k in reversed(steps):
        weight = F.when(u < bound, k).otherwise(weight)
    return weight.cast("double")


def train_propensity(examples: DataFrame, features: list[str], models: int = 3, trees: int = 10, depth: int = 3) -> list:
    """An ensemble of boosted trees, each on its own bootstrap; simulated examples weigh 0.3."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="features").transform(examples)
    base = F.when(F.col("source") == "sim", 0.3).otherwise(1.0)
    fitted = []
    for k in range(models):
        weighted = rows.withColumn("w", base * bootstrap_weight(F.col("correlationId"), k)).where("w > 0")
        fitted.append(GBTClassifier(labelCol="label", weightCol="w", maxIter=trees, maxDepth=depth, seed=k).fit(weighted))
    return fitted


def behaviour_clone(trans: DataFrame, arms: int, hidden: int = 16, steps: int = 40):
    """The logged policy as a classifier from observation to arm."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    rows = trans.select(array_to_vector("obs").alias("features"), F.col("arm").cast("double").alias("label"))
    width = trans.select(F.size("obs")).first()[0]
    return MultilayerPerceptronClassifier(layers=[width, hidden, arms], maxIter=steps, seed=1).fit(rows)


def promotion_gate(metrics: DataFrame, margin: float) -> DataFrame:
    """One row, promote and why: the challenger must beat the champion by ``margin`` on the first metric that both have, of snips, auc, sim."""
    pivoted = metrics.groupBy().agg(*(F.max(F.when((F.col("model") == m) & (F.col("metric") == k), F.col("value"))).alias(f"{m}_{k}") for m in ("champion", "challenger") for k in ("snips", "auc", "sim")))
    why = F.coalesce(*[F.when(F.col(f"champion_{k}").isNotNull() & F.col(f"challenger_{k}").isNotNull(), F.lit(k)) for k in ("snips", "auc", "sim")])
    gain = F.coalesce(*[F.col(f"challenger_{k}") - F.col(f"champion_{k}") for k in ("snips", "auc", "sim")])
    return pivoted.select(F.coalesce(gain >= margin, F.lit(False)).alias("promote"), why.alias("why"), gain.alias("gain"))


def clone_gate(readout: DataFrame, share: float = 0.75, floor: float = 0.12) -> DataFrame:
    """One row, promote, bar: a policy (agreement) must repeat the logged actions nearly as well as a clone of them can (cloneAgreement).

    The bar is ``share`` of the clone's agreement; both must also reach ``floor``, for what a clone cannot learn nobody can judge.
    """
    bar = share * F.col("cloneAgreement")
    passed = (F.col("cloneAgreement") >= floor) & (F.col("agreement") >= bar) & (F.col("agreement") >= floor)
    return readout.select(F.coalesce(passed, F.lit(False)).alias("promote"), bar.alias("bar"), "agreement", "cloneAgreement")


def down_sample(df: DataFrame, key: Column, share: float) -> DataFrame:
    """A stable sample of about ``share`` of the rows, by a hash of ``key``."""
    return df.where(stable01(key) < share)


def rank_serve(candidates: DataFrame, by: list[str], n: int) -> DataFrame:
    """The best ``n`` for each ``by``: completed last, then by falling score. Adds place."""
    order = Window.partitionBy(*by).orderBy("hardCompleted", F.desc_nulls_last("score"), "actionId", "channel")
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


