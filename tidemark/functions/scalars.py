"""Scalar functions of the decision engine as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000

# Source field names (lower case, without separators) and the fact keys they mean.
CRM_KEYS = {
    "dayssincelogin": "operator.activity.daysSinceLogin",
    "completedtasks": "operator.activity.completedTasks",
    "vieweddashboard": "operator.activity.viewedDashboard",
    "usedchat": "operator.activity.usedChat",
    "isdnc": "operator.profile.isDNC",
    "smsconsent": "operator.profile.smsConsent",
    "emailsthisweek": "operator.comms.emailsThisWeek",
    "totalcommsthisweek": "operator.comms.totalThisWeek",
}

# Provider statuses and the lifecycle states they mean; canonical states stand for themselves.
STATUS_STATES = {
    "Bounced": "FAILED", "Undelivered": "FAILED", "Failed": "FAILED", "NoAnswer": "FAILED",
    "Unsubscribe": "DECLINED", "STOP": "DECLINED", "Dismissed": "DECLINED", "Declined": "DECLINED",
    "Cancelled": "SUPPRESSED", "AlreadySent": "SUPPRESS_FAILED",
    "SUPPRESSED": "SUPPRESSED", "SUPPRESS_FAILED": "SUPPRESS_FAILED", "DECLINED": "DECLINED", "FAILED": "FAILED",
    "PRESENTED": "PRESENTED", "IN_PROCESS": "IN_PROCESS",
}

# States of a contact that is under way.
ACTIVE_STATES = ("CREATED", "IN_PROCESS", "SUPPRESSING", "PRESENTED", "SOFT_COMPLETED", "DECLINED")


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(values: dict[str, str], key: Column, default: str | None = None) -> Column:
    found = F.try_element_at(literal_map(values), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def camel(name: Column) -> Column:
    """snake_case or kebab-case to camelCase; the first part keeps its case."""
    parts = F.split(F.translate(name, "-", "_"), "_")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    return F.concat(parts[0], F.array_join(rest, ""))


def crm_key(field: Column) -> Column:
    """The fact key of a source field whatever its case and separators; null where there is none."""
    return lookup(CRM_KEYS, F.lower(F.translate(field, "_-", "")))


def value_type(token: Column) -> Column:
    """BOOLEAN, LONG, DOUBLE or STRING for a JSON scalar in its raw form."""
    return (
        F.when(token.isin("true", "false"), "BOOLEAN")
        .when(token.rlike(r"^-?[0-9]+$"), "LONG")
        .when(token.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), "DOUBLE")
        .otherwise("STRING")
    )


def json_string(value: Column) -> Column:
    """``value`` as a JSON string literal; null stays ``null``."""
    return F.coalesce(_trim_ends(F.to_json(F.array(value.cast("string")))), F.lit("null"))


def _trim_ends(text: Column) -> Column:
    return F.substr(text, F.lit(2), F.length(text) - 2)


def day_floor(ms: Column) -> Column:
    """The start of the UTC day of epoch milliseconds."""
    return ms - F.pmod(ms, F.lit(DAY_MS))


def next_midnight(ms: Column) -> Column:
    return day_floor(ms) + DAY_MS


def windows_left(now_ms: Column, window_s: int) -> Column:
    """How many windows of ``window_s`` seconds begin before the UTC day ends, one at least."""
    left_ms = next_midnight(now_ms) - now_ms
    return F.greatest(F.lit(1).cast("long"), F.ceil(left_ms / F.lit(1000 * window_s)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def stable01(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts only: the first 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967295).cast("double")


def crc_bucket(text: Column, n: int) -> Column:
    return F.crc32(text.cast("binary")) % n


def java_hash(text: Column) -> Column:
    """Java's ``String.hashCode`` for characters of the basic plane, as a signed 32-bit number."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    unsigned = F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)) % F.lit(1 << 32))
    return F.when(unsigned >= 1 << 31, unsigned - (1 << 32)).otherwise(unsigned)


def percent_bucket(text: Column) -> Column:
    """0 to 99 by the Java hash, for content splits."""
    return F.pmod(java_hash(text), F.lit(100))


def softmax(df, score: str, temperature: float, over, into: str):
    """``df`` with the softmax of ``score`` within the window ``over``, shifted by the maximum."""
    weighed = df.withColumn(into, F.exp((F.col(score) - F.max(score).over(over)) / F.lit(temperature)))
    return weighed.withColumn(into, F.col(into) / F.sum(into).over(over))


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(value).isin("completed", "true", "1"), F.lit(False))


def stable_id(*parts: Column) -> Column:
    """A surrogate id that reruns agree on."""
    return F.concat(F.lit("c_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def coerce(value: Column, kind: str) -> Column:
    """A feature as a double: ``bool`` takes true, t, yes or a number of 1 or more as 1; ``num`` parses or gives 0."""
    number = value.try_cast("double")
    if kind == "num":
        return F.coalesce(number, F.lit(0.0))
    yes = F.lower(F.trim(value)).isin("true", "t", "yes") | (number >= 1)
    return F.when(yes, 1.0).otherwise(0.0)


def disposition_state(raw: Column) -> Column:
    """The lifecycle state of a provider status; null, empty and unknown ones count as PRESENTED."""
    return lookup(STATUS_STATES, raw, "PRESENTED")
