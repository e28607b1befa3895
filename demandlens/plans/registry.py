"""Registered queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import VIEWS, Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
def with_views(sql: str) -> str:
    """The statement with the views that it names, and those that they name, as common table expressions before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    views = ", ".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    sql = sql.strip()
    if not views:
        return sql
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {sql[15:]}"
    return f"WITH {views}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {views} {sql}"


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under a name, with its SQL over the views where SQL can express it."""

    def put(f: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[name] = with_views(sql)
        return f

    return put


def _load() -> None:
    from . import change_queries, demand_queries, filter_queries, join_queries, scalar_queries, text_queries, work_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
