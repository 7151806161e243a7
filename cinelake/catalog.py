"""All queries of the core and their SQL, gathered from the modules that define them."""

from __future__ import annotations

import importlib

_MODULES = ("quality", "browsing", "statistics", "entities", "pipelines", "documented", "editing")
QUERIES: dict = {}
SQL: dict = {}
for _name in _MODULES:
    try:
        _module = importlib.import_module(f"cinelake.queries.{_name}")
    except ModuleNotFoundError as e:
        if e.name != f"cinelake.queries.{_name}":
            raise
        continue
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
