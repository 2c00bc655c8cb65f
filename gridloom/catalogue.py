"""Registry of the engine's queries and of the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import anomaly_queries, decision_queries, raster_queries, report_queries, workflow_queries
from .plans.registry import ORACLES, QUERIES

del anomaly_queries, decision_queries, raster_queries, report_queries, workflow_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
