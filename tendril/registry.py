"""Registered queries and their independent SQL oracle.

``QUERIES[name](spark, sf_dir)`` builds the Spark DataFrame over the role
views of the driver tables in ``sf_dir``; ``ORACLE[name]`` is the same
question as DuckDB SQL over the same parquet tables (role CTEs prefixed by
``with_roles``).  Column names agree on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tendril.sources.roles import CHANGES_AS_OF, EVENTS_AS_OF, MEASURE_AS_OF, role_tables, with_roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_roles(sql)
        return fn

    return deco


def T(spark: SparkSession, sf_dir: str):
    return role_tables(spark, sf_dir)


# SQL helpers (DuckDB dialect) --------------------------------------------------


def wd(a: str, b: str) -> str:
    """Whole 24h days of a - b, truncated toward zero."""
    return f"CAST(trunc((epoch_us({a}) - epoch_us({b})) / 86400000000.0) AS INTEGER)"


def cd(a: str, b: str) -> str:
    """Calendar days date(a) - date(b)."""
    return f"CAST(CAST({a} AS DATE) - CAST({b} AS DATE) AS INTEGER)"


def rr(num: str, den: str, digits: int) -> str:
    """ROUND(num/den, digits) half away from zero on integers."""
    s = 10**digits
    return f"(CASE WHEN {den} > 0 THEN sign({num}) * floor((abs({num}) * {2 * s} + {den}) / (2.0 * {den})) / {float(s)} END)"


def ts(v: str) -> str:
    return f"TIMESTAMP '{v}'"


EV = ts(EVENTS_AS_OF)
MS = ts(MEASURE_AS_OF)
CH = ts(CHANGES_AS_OF)

# Newest-first / oldest-first row orders with PostgreSQL NULL placement.
M_DESC = "measurement_date IS NULL DESC, measurement_date DESC, id DESC"
M_ASC = "measurement_date IS NULL, measurement_date, id"

from tendril import registry_views  # noqa: E402,F401  (registers on import)
from tendril import registry_functions  # noqa: E402,F401
from tendril import registry_temporal  # noqa: E402,F401
from tendril import registry_edits  # noqa: E402,F401
from tendril import registry_sql  # noqa: E402,F401
from tendril import registry_stored  # noqa: E402,F401
