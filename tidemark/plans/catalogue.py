"""Every registered query of the decision engine with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "a16_rule_funnel"

PARTS = ("ingest", "merging", "rules", "joining", "reports", "sequences", "learning", "stateful", "streams")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in PARTS:
    _module = import_module(f"tidemark.plans.{_part}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
