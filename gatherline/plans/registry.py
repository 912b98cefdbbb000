"""All queries of the library by name, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = ("resolution", "read_model", "bronze", "operations", "places_and_facts", "normalizers", "publishing", "posts", "gates", "series", "listings", "landing", "chats_and_venues", "pins_and_feeds")


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name, with the SQL that gives the same rows, if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    for m in MODULES:
        importlib.import_module(f"gatherline.plans.{m}")
    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return SQL
