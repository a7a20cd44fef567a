"""All queries over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from darkroom.plans import albums, cleaning, details, lifecycles, pictures, serving, timelines

FLAGSHIP = "exact_duplicates"
MODULES = (cleaning, timelines, albums, lifecycles, details, pictures, serving)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
