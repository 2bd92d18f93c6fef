"""The queries by name, and the SQL that checks them."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder of tables) under name, with the SQL that gives its rows."""

    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register
