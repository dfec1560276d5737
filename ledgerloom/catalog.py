"""Query catalog: every job of the library bound to the driver's data.

``QUERIES[key](spark, sf_dir)`` builds the retail tables over ``sf_dir``
(lazy views, see ``fixtures``), derives the report day from the data and
returns the job's DataFrame. The matching DuckDB SQL lives in ``oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures
from .tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

_TABLES: dict[tuple[str, int, str], Tables] = {}


def tables_for(spark: SparkSession, sf_dir: str) -> Tables:
    # the application id changes with every new SparkContext, so a stopped session's frames are never reused
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _TABLES:
        _TABLES[key] = fixtures.driver_tables(spark, sf_dir)
    return _TABLES[key]


def query(key: str):
    """Register ``fn(t: Tables) -> DataFrame`` under ``key``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tables_for(spark, sf_dir))
        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        return fn
    return deco


# register the domain bindings
from . import bindings  # noqa: E402,F401
