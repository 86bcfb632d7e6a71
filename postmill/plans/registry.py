"""Registry of named queries, each with its SQL cross-check where SQL can say the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postmill.plans.fixtures import ORACLE_VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = with_views(sql)
        return fn

    return register


def _views_used(sql: str) -> list[str]:
    """Names of the fixture views a statement needs, dependencies first."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name, body in ORACLE_VIEWS.items():
            if name not in found and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def with_views(sql: str) -> str:
    """Prepend the fixture views as common table expressions."""
    if sql.startswith("WITH RECURSIVE fx_"):
        return sql  # already done, for a query that shares another one's SQL
    views = ",\n".join(f"{name} AS ({ORACLE_VIEWS[name].strip()})" for name in _views_used(sql))
    sql = sql.strip()
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", sql, re.IGNORECASE)
    own = sql[head.end():] if head else sql
    if not views:
        return sql
    return f"WITH RECURSIVE {views}{',' if head else ''}\n{own}"
