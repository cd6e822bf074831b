"""Authored condition trees as Spark columns.

A tree is ``{"op": "all" | "any", "conditions": [tree or {"fact", "cmp", "value"}]}``. Facts are strings in a map. A missing
fact reads as the zero of the type it is compared with, except by ``exists``; an empty tree holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER = {"lt": "__lt__", "lte": "__le__", "gt": "__gt__", "gte": "__ge__", "eq": "__eq__", "ne": "__ne__"}


def fact(facts: Column, key: str) -> Column:
    return F.try_element_at(facts, F.lit(key))


def leaf(facts: Column, condition: dict) -> Column:
    """One comparison. ``in`` takes a list or comma-separated text."""
    raw, how, value = fact(facts, condition["fact"]), condition["cmp"], condition.get("value")
    if how == "exists":
        return raw.isNotNull()
    if how == "in":
        options = value if isinstance(value, list) else str(value).split(",")
        return F.coalesce(raw, F.lit("")).isin([str(x).strip() for x in options])
    if isinstance(value, bool):
        actual = F.coalesce(F.lower(raw).isin("true", "1"), F.lit(False))
        return actual == value if how == "eq" else actual != value
    if isinstance(value, int | float):
        actual = F.coalesce(raw.try_cast("double"), F.lit(0.0))
        return getattr(actual, ORDER[how])(F.lit(float(value)))
    return getattr(F.coalesce(raw, F.lit("")), ORDER[how])(F.lit(str(value)))


def tree_to_column(facts: Column, tree: dict | None) -> Column:
    if not tree or ("conditions" in tree and not tree["conditions"]):
        return F.lit(True)
    if "conditions" not in tree:
        return leaf(facts, tree)
    parts = [tree_to_column(facts, c) for c in tree["conditions"]]
    return reduce((lambda a, b: a | b) if tree.get("op") == "any" else (lambda a, b: a & b), parts)


def leaves(tree: dict | None) -> list[dict]:
    """The comparisons of a tree, in order."""
    if not tree:
        return []
    if "conditions" in tree:
        return [x for c in tree["conditions"] for x in leaves(c)]
    return [tree]


def facts_used(definition: dict) -> list[str]:
    """Sorted distinct facts of all trees of a definition, those of its variants included."""
    trees = [definition.get(k) for k in ("inclusion", "exclusion", "logic", "completion")]
    trees += [v.get("conditions") for c in definition.get("channels", []) for v in c.get("variants", [])]
    return sorted({x["fact"] for t in trees for x in leaves(t)})


def explain_leaf(facts: Column, condition: dict) -> Column:
    """struct<detail, passed>: what was compared, ``(default)`` where the fact is missing."""
    raw = fact(facts, condition["fact"])
    shown = F.when(raw.isNull(), F.lit("(default)")).otherwise(raw)
    expected = condition.get("value")
    expected = str(expected).lower() if isinstance(expected, bool) else "" if expected is None else str(expected)
    detail = F.concat_ws(" ", F.lit(condition["fact"]), shown, F.lit(condition["cmp"]), F.lit(expected))
    return F.struct(detail.alias("detail"), leaf(facts, condition).alias("passed"))
