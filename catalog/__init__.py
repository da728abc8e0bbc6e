"""Registered queries with their DuckDB counterparts, one module per family."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FAMILIES = (
    "sources", "fidelity", "structure", "profiling", "repair", "generation", "privacy", "utility", "ranking",
)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for family in FAMILIES:
        found.update(import_module(f"catalog.{family}").QUERIES)
    return found


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for family in FAMILIES:
        found.update(import_module(f"catalog.{family}").SQL)
    return found
