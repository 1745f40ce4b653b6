"""Latest / first row per key (A-7, A-8, J-5, J-6) as one aggregate pass.

The source repeats correlated ``ORDER BY date DESC LIMIT 1`` sub-queries and
``DISTINCT ON``.  Here one ``groupBy(key)`` computes every first/last value
with ``min_by`` / ``max_by`` over a struct payload: partial aggregation runs
before the shuffle, so a hot key costs one small row per task, never a
whole group in one task.

Time order follows PostgreSQL: a NULL date sorts as the newest (DESC puts
NULLs first, ASC puts them last), ties on the date are broken by ``id``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def time_order(date_col, id_col="id") -> Column:
    """Orderable struct: NULL dates after all dated rows, then date, then id."""
    d = _col(date_col)
    return F.struct(d.isNull().alias("_null"), d.alias("_d"), _col(id_col).alias("_id"))


def latest_per_key(
    df: DataFrame,
    key: str,
    cols: Sequence[str],
    date_col: str,
    id_col: str = "id",
    prefix: str = "",
    where: Column | None = None,
) -> DataFrame:
    """One row per key with ``cols`` of the newest row (NULL values kept).

    ``where`` restricts the candidate rows (e.g. non-NULL health) without a
    separate pass: rows failing it get a NULL order and are skipped by max_by.
    """
    order = time_order(date_col, id_col)
    if where is not None:
        order = F.when(where, order)
    payload = F.struct(*[F.col(c).alias(c) for c in cols])
    agg = df.groupBy(key).agg(F.max_by(payload, order).alias("_latest"))
    if where is not None:
        agg = agg.where(F.col("_latest").isNotNull())
    return agg.select(key, *[F.col("_latest")[c].alias(prefix + c) for c in cols])


def first_and_last(payload: Column, order: Column) -> tuple[Column, Column]:
    """(min_by, max_by) aggregates of one payload under one order."""
    return F.min_by(payload, order), F.max_by(payload, order)
