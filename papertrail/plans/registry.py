"""Registry of named queries and their DuckDB oracle SQL.

Each query is a function ``(spark, sf_dir) -> DataFrame`` over the
driver tables; ``sql`` (optional) is the ANSI SQL that DuckDB runs on the
same tables.  Column names of both sides are identical.
"""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco
