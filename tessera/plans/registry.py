"""Collects the queries of a module with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from tessera.plans.adapters import sql


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, oracle: str | None = None, *names: str) -> Callable:
        """Registers a function under its name; `oracle` is its SQL after the named common table expressions."""

        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if oracle:
                self.sql[f.__name__] = sql(oracle, *names)
            return f

        return add
