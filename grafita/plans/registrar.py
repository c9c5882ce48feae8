"""A pair of tables for queries and their SQL, and the decorator that fills them."""

from __future__ import annotations

from collections.abc import Callable

from grafita.plans.derived import SQL


def registrar() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    oracle: dict[str, str] = {}

    def reg(name: str, sql: str | None = None, derived: bool = False) -> Callable:
        def put(f: Callable) -> Callable:
            queries[f"op_{name}"] = f
            if sql:
                oracle[f"op_{name}"] = (SQL if derived else "") + sql
            return f

        return put

    return queries, oracle, reg
