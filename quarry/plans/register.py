"""Where queries register themselves with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(name: str, operators: str, sql: str | None = None) -> Callable:

    def add(f: Callable) -> Callable:
        QUERIES[name], OPERATORS[name] = f, operators
        if sql:
            ORACLES[name] = sql
        return f

    return add
