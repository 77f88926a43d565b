"""All registered queries and their SQL, by area."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wirelark.plans import flows, frames, functions, layers, relational

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: q for area in (functions, frames, layers, flows, relational) for name, (q, _) in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in (functions, frames, layers, flows, relational) for name, (_, sql) in area.QUERIES.items() if sql}
