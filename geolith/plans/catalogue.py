"""The queries by name, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    import importlib
    import pkgutil

    from . import queries

    for module in pkgutil.iter_modules(queries.__path__):
        importlib.import_module(f"{queries.__name__}.{module.name}")
    return QUERIES, SQL
