"""Named queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mediatimeline.plans.bridges import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register `fn(tables) -> DataFrame`; without `sql` only the rows are checked."""

    def register(fn: Callable[[Tables], DataFrame]):
        label = name or fn.__name__
        if label in QUERIES:
            raise ValueError(f"query {label!r} is registered twice")
        QUERIES[label] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[label] = sql
        return fn

    return register
