"""Where registered queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import views as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str, run: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = run
    ORACLES[name] = W.with_views(sql.strip())
