"""All queries of the engine with their oracle SQL: name -> (function of (spark, sf_dir), SQL or None)."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) as a query; sql is the same in DuckDB's dialect."""

    def keep(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep
