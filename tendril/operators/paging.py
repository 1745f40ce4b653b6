"""Sorting, pages and top-k (T-1 .. T-4, T-6).

Pages and top-k are features of the source (page sizes 12/20/20/24, top 5
events, 6 images), so ``limit`` here is the operator itself.  Every order
ends with ``id`` so pages are stable and their union is the full list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: Sequence[Column], page_no: int, size: int) -> DataFrame:
    """Rows of page ``page_no`` (1-based; below 1 is clamped, past the end is empty)."""
    page_no = max(int(page_no), 1)
    return df.orderBy(*order).offset((page_no - 1) * size).limit(size)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k (TakeOrderedAndProject: each task keeps k rows)."""
    return df.orderBy(*order).limit(k)


def top_k_per_key(df: DataFrame, key: str, order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """k first rows of every key under ``order``.

    ``row_number() <= k`` is planned with a partial group limit before the
    shuffle (WindowGroupLimit), so a hot key ships at most k rows per task.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def seek_order(keys: Sequence[str], descending: bool = True) -> list[Column]:
    """The lists' order: newest first with NULLs before all values, or oldest
    first with NULLs behind them (both as PostgreSQL places NULLs)."""
    return [F.col(k).desc_nulls_first() if descending else F.col(k).asc_nulls_last() for k in keys]


def page_after(df: DataFrame, keys: Sequence[str], last: Sequence | None, size: int, descending: bool = True) -> DataFrame:
    """Seek pagination: the ``size`` rows after the row whose sort key was
    ``last`` (None = first page; its values may be None).  Unlike OFFSET, deep
    pages do not make every task keep all earlier rows.  With a total order
    (ending in the id) the pages together are the full list."""
    out = df
    if last is not None:
        after = F.lit(False)  # nothing is after an equal row
        for name, value in zip(reversed(keys), reversed(list(last))):
            k = F.col(name)
            if value is None:
                after = (k.isNotNull() if descending else F.lit(False)) | (k.isNull() & after)
            else:
                v = F.lit(value)
                beyond = (k < v) if descending else ((k > v) | k.isNull())
                after = beyond | ((k == v) & after)
        out = out.where(after)
    return out.orderBy(*seek_order(keys, descending)).limit(size)


def page_totals(df: DataFrame, page_no: int, size: int) -> DataFrame:
    """One row for a list's footer: page, pages, total rows, has_prev, has_next."""
    page_no = max(int(page_no), 1)
    pages = F.ceil(F.col("total") / size).cast("int")
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(page_no).alias("page"),
        pages.alias("pages"),
        "total",
        F.lit(page_no > 1).alias("has_prev"),
        (F.lit(page_no) < pages).alias("has_next"),
    )


def lookup_keys(df: DataFrame, keys: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """F-4, batch form: rows of the requested keys, and the requested keys
    that do not exist ("not found")."""
    k = keys.select(F.col(keys.columns[0]).alias(key))
    return df.join(k, key, "left_semi"), k.join(df.select(key), key, "left_anti")
