"""The registry of queries with their SQL, which the modules of this package fill."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None):
    """Registers a query under its function's name; sql: what gives the same rows, None where SQL cannot say it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
