"""Registered queries of the knowledge operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import core


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(core.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(core.SQL)
