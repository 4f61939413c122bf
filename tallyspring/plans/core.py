"""All registered queries outside the optional subpackages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspring.plans import data_quality, driver_analysis

_MODULES = (driver_analysis, data_quality)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return driver_analysis.flagship(spark, folder)
