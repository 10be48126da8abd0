"""Names of the queries, each with its function and its SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphloom.plans import flows, measures, scoring, slants, studies, vision

Query = Callable[[SparkSession, str], DataFrame]

_FAMILIES = (scoring, measures, vision, flows, studies, slants)


def queries() -> dict[str, Query]:
    return {name: f for family in _FAMILIES for name, (f, _) in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in _FAMILIES for name, (_, sql) in family.QUERIES.items() if sql}
