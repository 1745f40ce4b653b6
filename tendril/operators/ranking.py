"""A sorted list in stored range parts: deep pages and dense numbers without a sort
in one place.

The rows are range-partitioned by their order and stored once, a folder per part;
the parts' counts, summed up, tell which places each part holds.  A page reads only
the parts it lies in, and every row's number is its part's first place plus its
place within the part.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tendril.session import checkpoint_path

#: Rows of a part (a task sorts one part).
PART_ROWS = 1_000_000
PART, PLACE = "_part", "_place"


@dataclass
class RankedList:
    rows: DataFrame  # stored, with the part's number
    order: list[Column]
    parts: list[tuple[int, int, int]]  # part, place before its first row, rows

    @property
    def total(self) -> int:
        return sum(n for *_, n in self.parts)

    def _placed(self, parts: list[tuple[int, int, int]]) -> DataFrame:
        """Rows of some parts with their place in the list, from 1 on."""
        spark = self.rows.sparkSession
        before = spark.createDataFrame([(p, b) for p, b, _ in parts], f"{PART} int, _before long")
        some = self.rows.where(F.col(PART).isin([p for p, *_ in parts])) if len(parts) < len(self.parts) else self.rows
        place = F.row_number().over(Window.partitionBy(PART).orderBy(*self.order))
        placed = some.withColumn(PLACE, place).join(F.broadcast(before), PART)  # a row per part
        return placed.withColumn(PLACE, F.col(PLACE) + F.col("_before")).drop(PART, "_before")

    def page(self, page_no: int, size: int) -> DataFrame:
        """Rows of page ``page_no`` (1-based; below 1 is clamped, past the end is empty), in
        no particular order but with their place in ``_place``."""
        first = (max(int(page_no), 1) - 1) * size
        parts = [x for x in self.parts if x[1] < first + size and x[1] + x[2] > first]
        if not parts:
            return self.rows.limit(0).drop(PART).withColumn(PLACE, F.lit(0).cast("long"))
        return self._placed(parts).where((F.col(PLACE) > first) & (F.col(PLACE) <= first + size))

    def numbered(self, name: str, start: Column | int = 0) -> DataFrame:
        """All rows with ``name`` = ``start`` + 1, 2, 3, ... in order, without gaps."""
        if not self.parts:
            return self.rows.drop(PART).withColumn(name, F.lit(0).cast("long"))
        start = start if isinstance(start, Column) else F.lit(start)
        return self._placed(self.parts).withColumn(name, (start + F.col(PLACE)).cast("long")).drop(PLACE)


def ranked(df: DataFrame, order: Sequence[Column], part_rows: int = PART_ROWS) -> RankedList:
    """Sorts and stores ``df``.  ``order`` must be total (end with an id): rows that
    compare equal lie in one part, in any order."""
    spark = df.sparkSession
    at = checkpoint_path(spark, f"ranked-{uuid.uuid4().hex}")
    n = max(1, -(-df.count() // part_rows))
    parts = df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id())
    parts.write.partitionBy(PART).parquet(at)
    rows = spark.read.schema(StructType([*df.schema.fields, StructField(PART, IntegerType())])).parquet(at)
    listed, before = [], 0
    for r in sorted(rows.groupBy(PART).agg(F.count("*").alias("n")).collect(), key=lambda r: r[PART]):
        listed.append((r[PART], before, r["n"]))
        before += r["n"]
    return RankedList(rows, list(order), listed)


def dense_table_rows(produced: DataFrame, table: DataFrame, order: Sequence[Column], part_rows: int = PART_ROWS) -> DataFrame:
    """SNK-1: produced rows in the shape of ``table``, ready to append, with ids that follow
    its greatest one without gaps, in ``order``."""
    start = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("start")).first()["start"]
    numbered = ranked(produced.drop("id") if "id" in produced.columns else produced, order, part_rows).numbered("id", start)
    have = set(numbered.columns)
    return numbered.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields]
    )
