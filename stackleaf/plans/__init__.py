"""Queries over the driver tables, each with its SQL, by family."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("queries", "more", "checks", "texts", "sessions", "search", "stores", "reports")


def _all(what: str) -> dict:
    found: dict = {}
    for family in FAMILIES:
        own = getattr(import_module(f"{__name__}.{family}"), what)()
        if twice := found.keys() & own.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        found |= own
    return found


def all_queries() -> dict:
    """All queries by name."""
    return _all("queries")


def all_sql() -> dict[str, str]:
    """The SQL of each query that SQL can express."""
    return _all("oracle_sql")
