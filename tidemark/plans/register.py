"""Collects the queries of a plan module and their SQL."""

from __future__ import annotations


class Register:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        """Decorator: registers a function (spark, sf_dir) under its name, with SQL for the same rows if there is any."""

        def add(query):
            self.queries[query.__name__] = query
            if sql is not None:
                self.sql[query.__name__] = sql
            return query

        return add
