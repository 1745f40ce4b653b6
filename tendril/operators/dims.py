"""Joins to dimension tables: broadcast only behind a checked size bound.

A dimension is broadcast only after ``limit(max_rows + 1).count()`` proved it
small (the check stops reading after ``max_rows + 1`` rows, so it is cheap
even on a large table).  Beyond the bound the plain join is used and Spark
picks sort-merge or, with AQE, a runtime broadcast / skew split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 100_000
MAX_ROWS_CONF = "spark.tendril.broadcast.maxRows"  # session setting


def max_rows_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(MAX_ROWS_CONF, str(DEFAULT_MAX_ROWS)))


def is_bounded(df: DataFrame, max_rows: int | None = None) -> bool:
    n = max_rows if max_rows is not None else max_rows_for(df)
    return df.limit(n + 1).count() <= n


class Dim:
    """A dimension DataFrame plus the result of its one-time size check."""

    def __init__(self, df: DataFrame, small: bool | None = None, max_rows: int | None = None):
        self.df = df
        self.small = is_bounded(df, max_rows) if small is None else small

    def for_join(self) -> DataFrame:
        return F.broadcast(self.df) if self.small else self.df
