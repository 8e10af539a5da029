"""Registered queries: each applies one operator to derived tables and names its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.fixtures import Tables, duck_with
from ..shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(*tables: str, sql: str | None = None):
    """Register a function of ``Tables`` under its own name.

    ``sql`` is a SELECT over the named derived tables, or further common table
    expressions and then a SELECT."""

    def wrap(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(ship(spark), sf_dir))
        if sql is not None:
            ctes = duck_with(list(tables))
            body = sql.strip()
            glue = "" if not ctes else (" " if body.upper().startswith("SELECT") else ", ")
            ORACLES[name] = (f"WITH {ctes}{glue}{body}" if ctes else (body if body.upper().startswith("SELECT") else f"WITH {body}"))
        return f

    return wrap
