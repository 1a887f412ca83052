"""How plan modules register a query and its SQL side by side."""

from __future__ import annotations

from vitrine.sources.domain import Domain


class Plans:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Register ``fn(domain) -> DataFrame`` under ``name``, with its SQL where there is one."""
        def register(fn):
            self.queries[name] = lambda spark, sf_dir: fn(Domain(spark, sf_dir))
            if sql is not None:
                self.oracles[name] = sql
            return fn
        return register
