"""A decorator that enters a query and its SQL in a module's tables."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def enter(f: Callable) -> Callable:
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return enter
