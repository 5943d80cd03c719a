"""Query registry shared by the query modules."""

from __future__ import annotations

from packspark.plans.spec import Query

REGISTRY: dict[str, Query] = {}

# Reference-test cycle inside the ~40-cycle test series (where the fixture energy steps up,
# as it does after a reference test); the same at every scale factor.
RPT = 12


def register(name: str, cols: str, sql: str | None = None, ids=()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, cols, sql, list(ids))
        return fn
    return deco
