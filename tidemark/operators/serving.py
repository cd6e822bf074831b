"""Decisions for members: from layered facts to eligible, scored and ranked contacts, and the log of what was predicted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import coerce
from tidemark.operators import joining, rules
from tidemark.operators.learning import rank_serve

Scorer = Callable[[DataFrame], DataFrame]


def parse_features(facts_json: Column, keys: dict[str, tuple[str, str]]) -> dict[str, Column]:
    """Features from a snapshot document: name to (fact key, kind); missing facts give 0."""
    facts = F.from_json(facts_json, "map<string,struct<value:string>>")
    return {name: coerce(F.try_element_at(facts, F.lit(key))["value"], kind) for name, (key, kind) in keys.items()}


def decide(requests: DataFrame, gold: DataFrame, defs: dict, scorer: Scorer, n: int) -> DataFrame:
    """The best ``n`` contacts for each member of ``requests`` (entityId, key, value, eventTs): its facts lie over the member's own.

    ``scorer`` adds score to (entityId, actionId, channel). A request without facts has a null key.
    """
    asked = requests.select("entityId").distinct()
    own = joining.scope_to(gold, asked, "entityId")
    merged = joining.merge_layers([own, requests.where("key is not null")], ["entityId"])
    members = merged.groupBy("entityId").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("facts"))
    scored = scorer(rules.eligible_hits(members, defs)).withColumn("hardCompleted", F.lit(False))
    return rank_serve(scored, ["entityId"], n).drop("hardCompleted")


def member_profile(members: DataFrame, drives: dict[str, str]) -> DataFrame:
    """What the compliance gate asks of a member, from its facts: isDNC, smsConsent, contactsThisWeek, achieved.

    ``drives``: the fact that an action brings about; an action whose fact the member has is achieved. Missing facts are false or 0.
    """
    facts = F.col("facts")

    def truth(key: str) -> Column:
        return coerce(F.try_element_at(facts, F.lit(key)), "bool") >= 1

    achieved = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(truth(fact), F.lit(a)) for a, fact in drives.items()]))
    week = coerce(F.try_element_at(facts, F.lit("operator.comms.totalThisWeek")), "num")
    return members.select("entityId", truth("operator.profile.isDNC").alias("isDNC"), truth("operator.profile.smsConsent").alias("smsConsent"), week.alias("contactsThisWeek"), achieved.alias("achieved"))


def rescore_all(members: DataFrame, defs: dict, scorer: Scorer, weekly_cap: int = 3, drives: dict[str, str] | None = None) -> DataFrame:
    """Fresh eligibility and scores of everyone who may be contacted. ``members``: entityId, facts.

    Inclusion is evaluated anew from the facts, then the compliance gate leaves out members on the list or at the weekly cap, sms without
    consent, and actions that the member has achieved.
    """
    hits = rules.eligible_hits(members, defs)
    return scorer(rules.compliance_gate(hits, member_profile(members, drives or {}), weekly_cap))


def log_predictions(scored: DataFrame, temperature: float, scored_ms: int) -> DataFrame:
    """Rows for the predictions log. ``scored``: entityId, actionId, channel, correlationId, evaluatedAt, score, emit, propensity."""
    return scored.select(
        F.col("entityId").alias("nbaId"), "actionId", "channel", "correlationId", F.col("score").alias("base_score"), F.col("emit").alias("emit_score"), "propensity",
        F.lit(temperature).alias("temperature"), "evaluatedAt", F.timestamp_millis(F.lit(scored_ms)).alias("scoredAt"),
    )


def summarize(topic: Column, e: dict[str, Column]) -> Column:
    """One line for people about an event. ``e``: op, name, key, value, n (eligible contacts or facts of a snapshot)."""
    acted = F.concat_ws(" ", e["op"], e["name"])
    return (
        F.when(topic == "nba.evaluations", F.format_string("%d eligible", e["n"]))
        .when(topic == "nba.snapshots", F.format_string("snapshot, %d facts", e["n"]))
        .when(topic == "nba.definitions", F.coalesce(e["name"], F.lit("definition")))
        .when((topic == "nba.activations") | e["op"].isNotNull(), acted)
        .otherwise(F.concat_ws(" = ", e["key"], e["value"]))
    )
