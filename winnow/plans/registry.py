"""Query registry and the composition of oracle SQL from named CTEs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def compose(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """Prefix ``body`` with the named CTEs it uses, directly or through other CTEs."""
    pool = {**CTES, **(extra or {})}
    order: list[str] = []

    def visit(text: str, me: str = "") -> None:
        for name in pool:
            if name != me and name not in order and re.search(rf"\b{name}\b", text):
                visit(pool[name], name)
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({pool[n]})" for n in order) + "\n" + body


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None,
          recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query and, when it has one, its ANSI-SQL twin."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = compose(sql, extra, recursive)
        return fn

    return register
