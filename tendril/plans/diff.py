"""Change feed from two stored snapshots of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.functions.days import as_ts


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``key, operation_type, old, new`` of every row that differs: INSERT (``old`` is NULL),
    DELETE (``new`` is NULL) or UPDATE, with both images as structs of the other columns.

    Both snapshots have the same columns and one row per key; values are compared with
    NULL equal to NULL.  One shuffle per side (none where both are bucketed by the
    key).  Rows without a key cannot be matched: they are deleted and inserted."""
    columns = [c for c in old.columns if c != key]
    image = lambda df, name: df.select(F.col(key).alias(f"_{name}"), F.struct(*columns).alias(name), F.lit(True).alias(f"_in_{name}"))
    both = image(old, "old").join(image(new, "new"), F.col("_old") == F.col("_new"), "full_outer")
    op = (
        F.when(F.col("_in_old").isNull(), "INSERT")
        .when(F.col("_in_new").isNull(), "DELETE")
        .when(~F.col("old").eqNullSafe(F.col("new")), "UPDATE")
    )
    changed = both.withColumn("operation_type", op).where(F.col("operation_type").isNotNull())
    return changed.select(F.coalesce("_old", "_new").alias(key), "operation_type", "old", "new")


def changes_of(diff: DataFrame, at, key: str = "id", changed_by: str = "diff") -> DataFrame:
    """The difference as a change feed (one change per key at time ``at``): the new image,
    of a DELETE the old one."""
    image = F.when(F.col("operation_type") == "DELETE", F.col("old")).otherwise(F.col("new"))
    names = diff.schema["new"].dataType.names
    return diff.withColumn("_image", image).select(
        key,
        *[F.col(f"_image.{c}").alias(c) for c in names],
        "operation_type",
        F.lit(changed_by).alias("changed_by"),
        as_ts(at).alias("changed_at"),
        F.lit(1).cast("long").alias("seq"),
    )
