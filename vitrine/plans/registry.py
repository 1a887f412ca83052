"""All registered queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ["base", "catalog", "ranking", "events", "state", "ledger", "landing", "served"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _plans = import_module(f"vitrine.plans.{_name}").plans
    _twice = QUERIES.keys() & _plans.queries.keys()
    if _twice:
        raise ValueError(f"registered twice: {sorted(_twice)}")
    QUERIES.update(_plans.queries)
    ORACLES.update(_plans.oracles)
