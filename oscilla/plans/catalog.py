"""Queries over the library's operators and the SQL they are held against, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import learning, reports, signals

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**signals.QUERIES, **reports.QUERIES, **learning.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**signals.ORACLES, **reports.ORACLES, **learning.ORACLES}
