"""Registry that pairs each Spark query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gridreach.plans.world import World, oracle_prefix


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[World], DataFrame]
    sql: str | None
    views: tuple[str, ...]

    def oracle(self) -> str | None:
        return None if self.sql is None else oracle_prefix(self.views, self.sql)


QUERIES: dict[str, Query] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query: `views` names the derived views the SQL refers to."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, tuple(views.split()))
        return fn

    return wrap
