"""Registered queries: name, Spark form and checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is left out where plain SQL cannot express it."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


# A mean of coordinates depends, in its last bits, on the order of adding. Where the mean lies exactly
# between two values of nine places those bits would decide the shown digit, so both sides add this.
NUDGE = 1e-11


def places(value: Column | str) -> Column:
    """A coordinate as shown by the queries: nine places."""
    return F.round((F.col(value) if isinstance(value, str) else value) + F.lit(NUDGE), 9)
