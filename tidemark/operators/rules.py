"""Eligibility by authored rules, content variants, completion, and arbitration of the contact slot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.conditions import explain_leaf, leaves, tree_to_column
from tidemark.functions.scalars import ACTIVE_STATES, percent_bucket

# How far a contact can get on each channel, in order; other channels are inbound.
FUNNELS = {
    "email": ["Delivered", "Opened", "LinkClicked"],
    "sms": ["Delivered", "LinkClicked"],
    "push": ["Delivered", "Opened"],
    "voice": ["Answered", "Completed"],
    "mail": ["Delivered"],
}
INBOUND = ["Presented", "Accepted", "Completed"]

# Statuses by which a member leaves a channel.
OPT_OUT = {"email": "Unsubscribe", "sms": "STOP"}

# Comparisons that each declared fact type allows.
ALLOWED = {"bool": ["exists", "eq", "ne"], "string": ["exists", "eq", "ne", "in"], "number": ["exists", "eq", "ne", "gt", "gte", "lt", "lte"]}


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def is_rate_rule(rule: dict) -> bool:
    return any(x["fact"].endswith(".rate") for x in leaves(rule.get("logic")))


def hit(facts: Column, action: dict, channel: str, defs: dict) -> Column:
    """Inclusion and every global rule and the channel's rules that are no rate rules, and not a non-empty exclusion."""
    rules = [r["logic"] for r in defs.get("globals", [])] + [r["logic"] for r in defs.get("channels", []) if r["channel"] == channel and not is_rate_rule(r)]
    parts = [tree_to_column(facts, action.get("inclusion")), *(tree_to_column(facts, r) for r in rules)]
    if leaves(action.get("exclusion")):
        parts.append(~tree_to_column(facts, action["exclusion"]))
    return _all(parts)


def eligible_hits(members: DataFrame, defs: dict) -> DataFrame:
    """entityId, actionId, channel of every hit. ``members``: entityId, facts (map). No cross join: each member's hits are one array."""
    pairs = [(a, c["channel"]) for a in defs["actions"] for c in a["channels"]]
    found = F.array(*[F.when(hit(F.col("facts"), a, c, defs), F.struct(F.lit(a["id"]).alias("actionId"), F.lit(c).alias("channel"))) for a, c in pairs])
    return members.select("entityId", F.explode(F.array_compact(found)).alias("h")).select("entityId", "h.*")


def funnel_position(channel: Column, status: Column) -> Column:
    """1 for the first stage of the channel's funnel; 0 for a status outside it."""
    stages = F.coalesce(*[F.when(channel == c, F.array(*map(F.lit, s))) for c, s in FUNNELS.items()], F.array(*map(F.lit, INBOUND)))
    return F.coalesce(F.array_position(stages, status), F.lit(0).cast("long"))


def soft_completed(channel: Column, status: Column, bar: Column) -> Column:
    """Whether the status got as far as the bar; a bar outside the funnel, or none, means its last stage."""
    last = F.coalesce(*[F.when(channel == c, F.lit(len(s))) for c, s in FUNNELS.items()], F.lit(len(INBOUND))).cast("long")
    at, want = funnel_position(channel, status), funnel_position(channel, bar)
    return (at > 0) & (at >= F.when(want > 0, want).otherwise(last))


def content_key(member: Column, facts: Column, base: str, variants: list[dict], salt: str) -> Column:
    """The first variant whose gate holds and whose share the member falls into, else the base content."""
    bucket = percent_bucket(F.concat_ws(":", member, F.lit(salt)))
    picks = [F.when(tree_to_column(facts, v.get("conditions")) & (bucket < v.get("percent", 100)), F.lit(v["contentKey"])) for v in variants]
    return F.coalesce(*picks, F.lit(base))


def completion_flags(criterion: Column, signalled: Column, state: Column, auto_exclude: Column) -> dict[str, Column]:
    """completed by criterion or signal; newly so by criterion only; excluded where completed, not under way and not told otherwise."""
    completed = criterion | signalled
    live = F.coalesce(state.isin(*ACTIVE_STATES), F.lit(False))
    return {"completed": completed, "newly_completed": criterion & ~signalled, "auto_excluded": completed & ~live & F.coalesce(auto_exclude, F.lit(True))}


def opted_out(dispositions: DataFrame) -> DataFrame:
    """entityId, channel of members who left a channel, by any action's latest status there."""
    left = reduce(lambda a, b: a | b, [(F.col("channel") == c) & (F.col("raw") == s) for c, s in OPT_OUT.items()])
    return dispositions.where(left).select("entityId", "channel").distinct()


def strip_suppressed(candidates: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Without actions that operators suppressed, on all channels (channel null) or on one."""
    everywhere = suppressed.where("channel is null").select(F.col("actionId").alias("s_action")).distinct()
    somewhere = suppressed.where("channel is not null").select(F.col("actionId").alias("s_action"), F.col("channel").alias("s_channel")).distinct()
    kept = candidates.join(everywhere, F.col("actionId") == F.col("s_action"), "left_anti")
    return kept.join(somewhere, (F.col("actionId") == F.col("s_action")) & (F.col("channel") == F.col("s_channel")), "left_anti")


def compliance_gate(candidates: DataFrame, members: DataFrame, weekly_cap: int) -> DataFrame:
    """Candidates of members who may be contacted: not on the list, consent for sms, under the cap, action not achieved.

    ``members``: entityId, isDNC, smsConsent, contactsThisWeek, achieved (array of actions).
    """
    joined = candidates.join(members, "entityId")
    open_ = ~F.col("isDNC") & ((F.col("channel") != "sms") | F.col("smsConsent")) & (F.col("contactsThisWeek") < weekly_cap)
    return joined.where(open_ & ~F.array_contains("achieved", F.col("actionId"))).select(candidates.columns)


def explain(members: DataFrame, action: dict, channel: str, defs: dict) -> DataFrame:
    """entityId, checks (array of stage, detail, passed) and blockedAt: the first stage that fails, null where none does."""
    facts = F.col("facts")
    stages = [("inclusion", action.get("inclusion"))] + [(r["name"], r["logic"]) for r in defs.get("globals", [])]
    stages += [(r["name"], r["logic"]) for r in defs.get("channels", []) if r["channel"] == channel and not is_rate_rule(r)]
    checks = [F.struct(F.lit(stage).alias("stage"), explain_leaf(facts, x)["detail"].alias("detail"), explain_leaf(facts, x)["passed"].alias("passed")) for stage, tree in stages for x in leaves(tree)]
    blocked = F.coalesce(F.lit(None).cast("string"), *[F.when(~tree_to_column(facts, tree), F.lit(stage)) for stage, tree in stages])
    return members.select("entityId", F.array(*checks).alias("checks"), blocked.alias("blockedAt"))


def rule_funnel(members: DataFrame, stages: list[tuple[str, dict | None]]) -> DataFrame:
    """stage, label, members: how many pass each stage and all before it, in one scan."""
    facts, passed, counts = F.col("facts"), F.lit(True), []
    for _, tree in stages:
        passed = passed & tree_to_column(facts, tree)
        counts.append(F.sum(F.when(passed, 1).otherwise(0)))
    steps = F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(label).alias("label"), F.coalesce(n, F.lit(0)).alias("members")) for i, ((label, _), n) in enumerate(zip(stages, counts, strict=True))])
    return members.agg(steps.alias("steps")).select(F.explode("steps").alias("s")).select("s.*")


def throttle_caps(defs: dict) -> dict[str, dict[str, int]]:
    """The tightest cap for each channel and metric: ``< N`` allows N, ``<= N`` allows N + 1."""
    caps: dict[str, dict[str, int]] = {}
    for rule in defs.get("channels", []):
        for x in leaves(rule["logic"]):
            parts = x["fact"].split(".")
            if parts[:2] == ["nba", "throttle"] and x["cmp"] in ("lt", "lte"):
                cap = int(x["value"]) + (x["cmp"] == "lte")
                own = caps.setdefault(parts[2], {})
                own[parts[3]] = min(cap, own.get(parts[3], cap))
    return caps


def validate_definitions(used: DataFrame, fact_types: DataFrame) -> DataFrame:
    """Comparisons that the declared type of their fact does not allow. ``used``: id, fact, cmp; ``fact_types``: fact, type."""
    allowed = F.coalesce(*[F.when(F.col("type") == t, F.array(*map(F.lit, c))) for t, c in ALLOWED.items()], F.array(F.lit("exists")))
    return used.join(fact_types, "fact", "left").where(~F.array_contains(allowed, F.col("cmp"))).select("id", "fact", "cmp", F.coalesce("type", F.lit("undeclared")).alias("type"))


SLUG = ("actionId", "channel")


def _slug() -> Column:
    return F.concat_ws("::", *SLUG)


def arbitrate_slot(candidates: DataFrame, by: list[str]) -> DataFrame:
    """For each ``by`` the occupant (best eligible under way) and the candidate (best eligible that is free and scored).

    Ties go to the smallest slug. One aggregate: rows are reduced before they are shuffled.
    """
    row = F.struct("actionId", "channel", "score", "cancellable")
    worst = F.coalesce("score", F.lit(float("-inf")))

    def best(condition: Column) -> Column:
        return F.min_by(row, F.when(condition, F.struct((-worst).alias("s"), _slug().alias("slug"))))

    eligible = F.col("eligible")
    free = eligible & ~F.col("active") & ~F.col("hardCompleted") & F.col("score").isNotNull()
    return candidates.groupBy(*by).agg(best(eligible & F.col("active")).alias("occupant"), best(free).alias("candidate"))


def select_batch(candidates: DataFrame, by: list[str], max_batch: dict[str, int]) -> DataFrame:
    """The free candidates that go out together: the best on the winning candidate's channel, up to the channel's batch size."""
    slots = arbitrate_slot(candidates, by).where("occupant is null and candidate is not null").select(*by, F.col("candidate.channel").alias("winning"))
    free = candidates.where(F.col("eligible") & ~F.col("active") & ~F.col("hardCompleted") & F.col("score").isNotNull())
    limit = F.coalesce(*[F.when(F.col("channel") == c, F.lit(n)) for c, n in max_batch.items()], F.lit(1))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "actionId")
    chosen = free.join(slots, by).where("channel = winning").withColumn("place", F.row_number().over(order))
    return chosen.where(F.col("place") <= F.greatest(limit, F.lit(1))).drop("winning")


def route(candidates: DataFrame, by: list[str], suppressed: DataFrame | None = None, max_batch: dict[str, int] | None = None) -> DataFrame:
    """``by``, op, actionId, channel, actions: what the router does for each evaluation.

    HARD_COMPLETE or else SOFT_COMPLETE for completed contacts; SUPPRESS for unsent ones no longer eligible and for an unsent
    occupant that a candidate outscores; CREATE for the candidate where the slot is free, or CREATE_BATCH with the best ``actions``
    on its channel where ``max_batch`` lets several go out there. What operators suppressed (``suppressed``: actionId, channel or null
    for all) is neither completed nor takes or keeps a slot, but an unsent one that is no longer eligible is still called off.
    """
    open_ = candidates if suppressed is None else strip_suppressed(candidates, suppressed)
    none = F.lit(None).cast("array<string>").alias("actions")
    done = open_.withColumn("op", F.when(F.col("hardCompleted"), "HARD_COMPLETE").when(F.col("softCompleted"), "SOFT_COMPLETE")).where("op is not null")
    fallen = candidates.where(~F.col("eligible") & F.col("cancellable")).withColumn("op", F.lit("SUPPRESS"))
    outscored = F.col("candidate").isNotNull() & F.col("occupant.cancellable") & (F.col("candidate.score") > F.coalesce("occupant.score", F.lit(float("-inf"))))
    replaced = arbitrate_slot(open_, by).where(outscored).select(*by, "occupant.actionId", "occupant.channel", F.lit("SUPPRESS").alias("op"))
    batch = select_batch(open_, by, max_batch or {}).groupBy(*by, "channel").agg(F.array_sort(F.collect_list(F.struct("place", "actionId"))).alias("b"))
    many = F.size("b") > 1
    created = batch.select(*by, F.when(many, "CREATE_BATCH").otherwise("CREATE").alias("op"), F.when(~many, F.get("b.actionId", F.lit(0))).alias("actionId"), "channel", F.when(many, F.col("b.actionId")).alias("actions"))
    single = reduce(DataFrame.unionByName, [df.select(*by, "op", *SLUG, none) for df in (done, fallen, replaced)])
    return single.unionByName(created)


def evaluation_signatures(candidates: DataFrame, by: list[str]) -> DataFrame:
    """fullSig and eligSig: digests of an evaluation that change with anything in it, and with the set of eligible contacts."""
    ident = F.concat_ws("::", "actionId", "channel", F.coalesce("contentKey", F.lit("")))
    flags = F.concat_ws("#", ident, F.coalesce(F.col("score").cast("string"), F.lit("null")), F.coalesce("workflowState", F.lit("null")), F.col("eligible").cast("string"), F.col("softCompleted").cast("string"), F.col("hardCompleted").cast("string"))

    def digest(parts: Column) -> Column:
        return F.sha2(F.array_join(F.array_sort(parts), "|"), 256)

    return candidates.groupBy(*by).agg(digest(F.collect_list(flags)).alias("fullSig"), digest(F.collect_list(F.when(F.col("eligible"), ident))).alias("eligSig"))


def evaluate_changed(signatures: DataFrame, last: DataFrame, by: list[str]) -> DataFrame:
    """Evaluations that differ from the last one emitted, with type ``eligibility`` where the eligible set moved, else ``score``."""
    old = last.select(*by, F.col("fullSig").alias("oldFull"), F.col("eligSig").alias("oldElig"))
    joined = signatures.join(old, by, "left").where(~F.col("fullSig").eqNullSafe(F.col("oldFull")))
    kind = F.when(F.col("eligSig").eqNullSafe(F.col("oldElig")), "score").otherwise("eligibility")
    return joined.select(*by, "fullSig", "eligSig", kind.alias("type"))


def detect_latches(passing: DataFrame, latched: DataFrame, keys: list[str]) -> DataFrame:
    """What holds now and has no durable fact yet."""
    return passing.join(latched.select(keys).distinct(), keys, "left_anti")
