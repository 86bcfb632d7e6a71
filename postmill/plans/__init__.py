"""Named queries over the given tables, each with its SQL cross-check where there is one."""

from __future__ import annotations

import importlib

# modules that register queries when imported
MODULES = [
    "listing", "search", "text", "media", "feed", "facts", "migrate", "sources", "tokens", "streams",
]


def all_queries():
    from postmill.plans import registry

    for name in MODULES:
        importlib.import_module(f"postmill.plans.{name}")
    return registry.QUERIES, registry.ORACLE
