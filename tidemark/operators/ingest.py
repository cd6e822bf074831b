"""From raw records to canonical facts: decoding, quarantine, routing, normalisation and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import camel, coerce, crm_key, value_type

# Channels in the order that reports use.
CHANNELS = ("email", "sms", "push", "voice", "mail")

# Provider statuses that a channel turns into engagement features, in the order of the feature block.
ENGAGEMENT = {
    "email": {"Opened": "opened", "LinkClicked": "link_clicked", "EXPIRED": "ignored", "Unsubscribe": "unsubscribe"},
    "sms": {"LinkClicked": "link_clicked", "EXPIRED": "ignored", "STOP": "stop"},
    "push": {"Opened": "opened", "Dismissed": "dismissed", "EXPIRED": "ignored"},
    "voice": {"Answered": "answered", "Completed": "answered", "Declined": "declined", "EXPIRED": "ignored"},
}
ENGAGEMENT_COLUMNS = list(dict.fromkeys(f"{name}_{channel}" for channel, names in ENGAGEMENT.items() for name in names.values()))


def split_malformed(df: DataFrame, payload: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows whose ``payload`` is a JSON object, with its fields as struct ``data``, and all others with an ``error``."""
    parsed = F.from_json(F.col(payload), f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    is_object = F.coalesce(F.trim(F.col(payload)).startswith("{"), F.lit(False))
    tried = df.withColumn("data", parsed)
    ok = is_object & F.col("data._bad").isNull()
    error = F.when(F.col(payload).isNull(), "empty payload").when(~is_object, "not a JSON object").otherwise("malformed JSON")
    return tried.where(ok).withColumn("data", F.col("data").dropFields("_bad")), tried.where(~ok).drop("data").withColumn("error", error)


def to_dlq(bad: DataFrame, consumer: str, now_ms: int) -> DataFrame:
    """Quarantine envelopes of bad rows (columns topic, partition, offset, key, value, headers, error)."""
    return bad.select(F.lit(consumer).alias("consumer"), "topic", "partition", "offset", "key", "value", "headers", "error", F.lit(now_ms).cast("long").alias("dlqTs"))


def replay_dlq(dlq: DataFrame, consumer: str, replayed: DataFrame) -> DataFrame:
    """The original (topic, key, value, headers) of a consumer's envelopes that have a source and were not replayed before."""
    place = ["topic", "partition", "offset"]
    due = dlq.where((F.col("consumer") == consumer) & F.col("topic").isNotNull() & F.col("offset").isNotNull())
    return due.join(replayed.select(place), place, "left_anti").select(*place, "key", "value", "headers")


def fact_to_json(value: Column, kind: Column) -> Column:
    """A fact's value as a JSON scalar of its type; BOOL is BOOLEAN, null stays null, unreadable numbers become text."""
    text = F.to_json(F.array(value))
    quoted = F.substr(text, F.lit(2), F.length(text) - 2)
    number = F.when(kind.isin("LONG", "DOUBLE") & value.try_cast("double").isNotNull(), value)
    flag = F.when(kind.isin("BOOL", "BOOLEAN") & F.lower(value).isin("true", "false"), F.lower(value))
    return F.coalesce(number, flag, quoted, F.lit("null"))


def has_header(headers: Column, name: str, value: str | None = None) -> Column:
    def same(h: Column) -> Column:
        return (h["key"] == name) if value is None else (h["key"] == name) & (h["value"] == value)

    return F.coalesce(F.exists(headers, same), F.lit(False))


def drop_origin(df: DataFrame) -> DataFrame:
    """Without the lake's own re-emissions, known by the ``origin`` header."""
    return df.where(~has_header(F.col("headers"), "origin"))


def drop_score_evals(df: DataFrame) -> DataFrame:
    """Loop guard: without evaluations that a score caused."""
    return df.where(~has_header(F.col("headers"), "type", "score"))


def with_fact_dims(facts: DataFrame) -> DataFrame:
    """Adds factClass, actionId, channel by the dotted key; external sends become dispositions with the value ``sent``."""
    key, parts = F.col("key"), F.split("key", r"\.")
    plain = F.coalesce(*[F.when(key.startswith(f"operator.{c}"), c) for c in ("activity", "comms", "profile")])
    own, external = key.rlike(r"^nba\.(score|actionstate|disposition)"), key.startswith("comms.sent.")
    kind = F.coalesce(plain, F.when(own, F.get(parts, F.lit(1))), F.when(external, "disposition"), F.lit("other"))
    action = F.when(own, F.get(parts, F.lit(2))).when(external, "external")
    channel = F.when(own, F.get(parts, F.lit(3))).when(external, F.get(parts, F.lit(2)))
    return facts.withColumns({"value": F.when(external, "sent").otherwise(F.col("value")), "factClass": kind, "actionId": action, "channel": channel})


# The fields of all source dialects.
BAGS = ("fields", "attributes", "props", "properties")
BILLING = ("plan", "mrr", "seats", "status", "trialDaysLeft")
TICKET = ("account", "accountId", "csat", "priority", "openTickets")
FIELDS = ("_src", "system", "source", "ts", "eventTs", "timestamp", "contactId", "contact_id", "id", "customer", "customerId", "event", "user", "uid", "userId", "entityId", "entityType", "key", "value", "valueType")


def inbound_schema() -> str:
    """One struct that holds a record of any dialect; scalars keep their text."""
    scalars = [f"{n} STRING" for n in dict.fromkeys(FIELDS + BILLING + TICKET)]
    ticket = ", ".join(f"{n}: STRING" for n in TICKET)
    return ", ".join([*scalars, *(f"{n} MAP<STRING, STRING>" for n in BAGS), f"ticket STRUCT<{ticket}>"])


def normalize_inbound(raw: DataFrame, payload: str = "payload", default_ts: int = 0) -> DataFrame:
    """Canonical facts from records of several source dialects; unknown shapes and null values give none.

    The first dialect that fits decides: CRM export, billing row, product event, support ticket (or a support record without
    one), canonical fact. Empty texts and bags count as absent where they identify a record, and so does a time of 0. Values are typed by their text,
    but a canonical fact keeps the entity type and the value type that it names. Each record is parsed once.
    """
    j = F.col("j")

    def given(*names: str, of: Column = j) -> Column:
        return F.coalesce(*[F.when(of[n] != "", of[n]) for n in names])

    def bag(*names: str) -> Column:
        return F.coalesce(*[F.when(F.size(j[n]) > 0, j[n]) for n in names], F.create_map().cast("map<string,string>"))

    def fact(key: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), value.alias("value"))

    def named(names: tuple[str, ...], of: Column) -> Column:
        return F.array(*[fact(F.lit(f"operator.{n}"), of[n]) for n in names])

    source = F.lower(F.coalesce(given("_src", "system", "source"), F.lit("unknown")))
    ts = F.coalesce(*[F.nullif(given(n).try_cast("long"), F.lit(0).cast("long")) for n in ("ts", "eventTs", "timestamp")], F.lit(default_ts).cast("long"))
    ticket = F.coalesce(j["ticket"], F.struct(*[j[n].alias(n) for n in TICKET]))
    dialect = (
        F.when(given("contactId", "contact_id").isNotNull() | source.startswith("crm"), "crm")
        .when(given("account", "customer").isNotNull() | (source == "billing"), "billing")
        .when(given("event").isNotNull() | source.startswith("product") | source.startswith("events"), "product")
        .when(j["ticket"].isNotNull() | (source == "support"), "support")
        .when(given("entityId").isNotNull() & given("key").isNotNull(), "canonical")
    )
    # Exploding keeps the optimiser from copying the parse into each condition on its fields.
    parsed = raw.select(F.explode(F.array(F.from_json(payload, inbound_schema()))).alias("j"))
    parsed = parsed.select("j", source.alias("source"), ts.alias("eventTs"), dialect.alias("dialect"))

    def by_dialect(**columns: Column) -> Column:
        return F.coalesce(*[F.when(F.col("dialect") == d, c) for d, c in columns.items()])

    who = by_dialect(
        crm=given("contactId", "contact_id", "id"), billing=given("account", "customer", "customerId"), product=given("user", "uid", "userId"),
        support=given("account", "accountId", of=ticket), canonical=given("entityId"),
    )
    facts = by_dialect(
        crm=F.transform(F.map_entries(bag("fields", "attributes")), lambda e: fact(F.coalesce(crm_key(e["key"]), F.concat(F.lit("operator.activity."), camel(e["key"]))), e["value"])),
        billing=named(BILLING, j),
        product=F.concat(F.array(fact(F.lit("operator.lastEvent"), given("event"))), F.transform(F.map_entries(bag("props", "properties")), lambda e: fact(F.concat(F.lit("operator."), camel(e["key"])), e["value"]))),
        support=named(("csat", "priority", "openTickets"), ticket),
        canonical=F.array(fact(j["key"], j["value"])),
    )
    own = F.col("dialect") == "canonical"
    rows = parsed.select(
        F.coalesce(F.when(own, j["entityType"]), F.lit("OPERATOR")).alias("entityType"), who.alias("entityId"), F.when(own, given("valueType")).alias("ownType"),
        "eventTs", F.concat(F.lit("lake:"), F.col("source")).alias("source"), F.explode_outer(facts).alias("f"),
    ).where("entityId is not null and f.value is not null")
    return rows.select("entityType", "entityId", "f.key", "f.value", F.coalesce("ownType", value_type(F.col("f.value"))).alias("valueType"), "eventTs", "source")


def melt_facts(df: DataFrame, ids: list[str], spec: list[tuple[str, str, str]]) -> DataFrame:
    """One row for each non-null column of ``spec`` (column, fact key, type) of a wide row."""
    made = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value"), F.lit(t).alias("valueType")) for c, k, t in spec])
    return df.select(*ids, F.explode(made).alias("f")).select(*ids, "f.*").where("value is not null")


def pivot_features(facts: DataFrame, by: str, keys: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each ``by`` with the features ``keys``: name to (fact key, kind). The key list is fixed, so no scan for it."""
    columns = [coerce(F.max(F.when(F.col("key") == k, F.col("value"))), kind).alias(n) for n, (k, kind) in keys.items()]
    return facts.where(F.col("key").isin([k for k, _ in keys.values()])).groupBy(by).agg(*columns)


def member_fact_map(facts: DataFrame, by: str = "entityId") -> DataFrame:
    """``by`` and a map of its facts; of several values of a key the one of latest eventTs, then greatest value."""
    latest = facts.groupBy(by, "key").agg(F.max_by("value", F.struct("eventTs", "value")).alias("value"))
    return latest.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("facts"))


ALWAYS_KEPT = ("nba.score.", "nba.actionstate.", "nba.disposition.", "nba.completion.", "nba.milestone.")


def lean_filter(facts: DataFrame, rule_facts: DataFrame) -> DataFrame:
    """Facts that some rule uses, and the engine's own always; with no rule facts at all everything stays."""
    own = F.lit(False)
    for prefix in ALWAYS_KEPT:
        own = own | F.col("key").startswith(prefix)
    used = rule_facts.select(F.col("key").alias("used")).distinct()
    any_rule = used.agg((F.count(F.lit(1)) > 0).alias("any_rule"))
    marked = facts.join(used, F.col("key") == F.col("used"), "left").crossJoin(F.broadcast(any_rule))
    return marked.where(own | F.col("used").isNotNull() | ~F.col("any_rule")).drop("used", "any_rule")


def classify(facts: DataFrame) -> DataFrame:
    """Each fact once for each of its routes: definitions, hot, firehose, snapshot.

    Throttle levels and suppressions are definitions, saturation marks a channel hot, kind-tagged facts go to the
    firehose too, router decisions are not snapshotted.
    """
    key, kind = F.col("key"), F.col("kind")
    control = key.startswith("nba.throttle.") | key.startswith("nba.actionsuppress.")
    routes = F.array(
        F.when(control, "definitions"),
        F.when(key.startswith("nba.throttle.") & (F.coalesce(kind, F.lit("")) == "saturated"), "hot"),
        F.when(~control & kind.isNotNull(), "firehose"),
        F.when(~control & (F.coalesce(kind, F.lit("")) != "router"), "snapshot"),
    )
    return facts.select("*", F.explode(F.array_compact(routes)).alias("route"))


def flatten_score(value: Column) -> Column:
    """The number of a score that is either plain or an object with ``score``."""
    return F.coalesce(F.get_json_object(value, "$.score"), value).try_cast("double")


def explode_activation(acts: DataFrame) -> DataFrame:
    """One row for each action of a batch activation, or the activation itself."""
    own = F.array(F.struct("actionId", "channel", "name", "score"))
    each = F.when(F.coalesce(F.size("actions"), F.lit(0)) > 0, F.col("actions")).otherwise(own)
    rest = [c for c in acts.columns if c not in ("actionId", "channel", "name", "score", "actions")]
    return acts.select(*rest, F.explode(each).alias("a")).select(*rest, "a.*")


def parse_definition(df: DataFrame) -> DataFrame:
    """Dimension rows from keyed documents (columns key, value, updatedTs): type from the key, sub-documents as JSON."""
    def part(path: str) -> Column:
        return F.get_json_object("value", f"$.{path}")

    return df.select(
        part("id").alias("id"), F.substring_index("key", ":", 1).alias("defType"), part("name").alias("name"),
        part("ttlSeconds").cast("long").alias("ttlSeconds"), part("channels").alias("channelsJson"), part("inclusion").alias("inclusionJson"),
        F.array_sort(F.array_distinct(F.regexp_extract_all("value", F.lit('"fact":"([^"]+)"'), F.lit(1)))).alias("factsUsed"), "updatedTs",
    )


def action_fact_map(dim: DataFrame) -> DataFrame:
    return dim.where("defType = 'ACTION'").select(F.col("id").alias("actionId"), F.explode("factsUsed").alias("key"))


# Definitions of tests by name, and what marks test content; milestones by the tasks that their gate asks for.
TEST_NAMES, TEST_CONTENT = ("varianttest", "complcrit", "complnoexcl"), "vtest"
GATES = ((6, "upgraded"), (3, "engaged"), (float("-inf"), "onboarded"))
UNGATED, GATE_FACT = "activated", "completedTasks"


def condition_leaves(tree_json: Column) -> Column:
    """The comparisons (fact, cmp, value) of a condition tree in JSON at any depth, in the order in which they stand.

    A leaf is an object without objects in it; braces inside texts are not expected. Broken or missing JSON has no leaves.
    """
    objects = F.coalesce(F.regexp_extract_all(tree_json, F.lit(r"(\{[^{}]*\})"), F.lit(1)), F.array().cast("array<string>"))
    leaf = "fact string, cmp string, value string"
    return F.filter(F.transform(objects, lambda x: F.from_json(x, leaf)), lambda x: x["fact"].isNotNull())


def milestone_group(inclusion: Column) -> Column:
    """The milestone that an action leads to, by the number of completed tasks that its gate asks for (the last such condition), else the first one."""
    tasks = F.transform(F.filter(condition_leaves(inclusion), lambda x: x["fact"].endswith(GATE_FACT) & x["value"].try_cast("double").isNotNull()), lambda x: x["value"].try_cast("double"))
    last = F.try_element_at(tasks, F.lit(-1))
    return F.when(last.isNull(), UNGATED).otherwise(F.coalesce(*[F.when(last >= bar, name) for bar, name in GATES]))


def driven_fact(used: Column, inclusion: Column) -> Column:
    """The fact that an action brings about: the first that it uses and that its gate does not ask for at any depth, by its last name."""
    gate = F.transform(condition_leaves(inclusion), lambda x: x["fact"])
    return F.substring_index(F.try_element_at(F.filter(used, lambda f: ~F.array_contains(gate, f)), F.lit(1)), ".", -1)


def load_arms(dim: DataFrame) -> DataFrame:
    """actionId, channel, name, group, drives, arm: one arm for each (action, channel) with a stable index in the order of their names.

    ``group`` is the milestone of the gate, ``drives`` the fact that a conversion brings about. Definitions of tests, by name or
    content, and channels without a name have no arm. Only the catalogue is ordered, which is as large as what people author.
    """
    from pyspark.sql import Window

    channels = F.from_json("channelsJson", "array<struct<channel:string, contentKey:string>>")
    junk = F.lower(F.coalesce("name", F.lit(""))).isin(*TEST_NAMES) | F.exists(channels, lambda c: F.coalesce(c["contentKey"].contains(TEST_CONTENT), F.lit(False)))
    actions = dim.where((F.col("defType") == "ACTION") & F.col("id").isNotNull() & ~F.coalesce(junk, F.lit(False)))
    arms = actions.select(F.col("id").alias("actionId"), "name", milestone_group(F.col("inclusionJson")).alias("group"), driven_fact(F.col("factsUsed"), F.col("inclusionJson")).alias("drives"), F.explode(channels).alias("c"))
    arms = arms.select("actionId", "c.channel", "name", "group", "drives").where("coalesce(channel, '') <> ''").distinct()
    return arms.withColumn("arm", (F.row_number().over(Window.orderBy("actionId", "channel")) - 1).cast("long"))


def parse_tracking(tracking: Column) -> dict[str, Column]:
    """nbaId, actionId, channel of ``nba-ca:member:action:channel|correlation``; null where the prefix is missing."""
    core = F.when(tracking.startswith("nba-ca:"), F.regexp_replace(F.substr(tracking, F.lit(8)), r"\|[^|]*$", ""))
    parts = F.split(core, ":")
    return {n: F.get(parts, F.lit(i)) for i, n in enumerate(("nbaId", "actionId", "channel"))}


def engagement_onehot(df: DataFrame, by: list[str]) -> DataFrame:
    """For each ``by`` the 13 engagement flags of its (channel, raw) rows."""
    def flag(column: str) -> Column:
        name, channel = column.rsplit("_", 1)
        statuses = [raw for raw, n in ENGAGEMENT[channel].items() if n == name]
        return F.max(F.when((F.col("channel") == channel) & F.col("raw").isin(statuses), 1).otherwise(0)).alias(column)

    return df.groupBy(*by).agg(*[flag(c) for c in ENGAGEMENT_COLUMNS])
