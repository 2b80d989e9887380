"""All queries of the library by name, with their SQL equivalents."""

from __future__ import annotations

import importlib

#: Modules that each define QUERIES and SQL.
MODULES = tuple(f"strataquery.plans.{m}" for m in ("general", "content", "symbol", "calls", "callgraph", "trees", "other"))
FLAGSHIP = "tfidf_multi_or"


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        for key, value in getattr(importlib.import_module(name), attribute).items():
            if key in merged:
                raise ValueError(f"two queries are named {key}")
            merged[key] = value
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
