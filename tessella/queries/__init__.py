"""Queries over the driver's tables, one or more per operator, with the same relation in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable) -> Callable:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries named {key}")
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


def fixed(expr: str) -> str:
    """Four decimals as a whole number, the same on both engines."""
    return f"CAST(floor(({expr}) * 10000 + 0.5) AS BIGINT)"
