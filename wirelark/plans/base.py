"""How queries are registered: a Spark function and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from wirelark.plans.derived import PACKETS_SQL


def query(into: dict, sql: str | None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f: Callable) -> Callable:
        into[name or f.__name__] = (f, sql)
        return f

    return add


def packets_sql(select: str, more: str = "") -> str:
    return f"WITH {PACKETS_SQL}{', ' + more if more else ''} {select}"


def quad(x: str) -> str:
    return f"concat_ws('.', (({x}) >> 24) & 255, (({x}) >> 16) & 255, (({x}) >> 8) & 255, ({x}) & 255)"
