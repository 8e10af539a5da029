"""Registered queries of the catalogue operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import registry
from .registry import compare, filters, rest, stats
from .shipping import ship

__all__ = ["compare", "filters", "oracle_sql", "queries", "rest", "stats"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        return lambda spark, sf_dir: f(ship(spark), sf_dir)

    return {name: shipped(f) for name, f in registry.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
