"""Named queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function under its own name, or under ``name``."""

    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            ORACLE[key] = sql
        return function

    return add
