"""All queries of the core by name, and the SQL that says the same."""

from __future__ import annotations

from gleanmark.plans import archives, capture, details, flows, pages, posts

_MODULES = (capture, pages, posts, flows, archives, details)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
