"""Writes as batch jobs (SNK-1 .. SNK-7).

Single-row screens of the source (add / edit / delete / complete one record)
become DataFrame-in, DataFrame-out jobs over a whole batch of requests; the
result is a new snapshot to write, never an in-place update.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.functions.days import END_OF_TIME, as_ts
from tendril.plans.temporal import STATE_COLS

# Column defaults of the source tables (apart from "now").
DEFAULTS = {
    "plant_types": {"watering_frequency_days": 7, "fertilizing_frequency_days": 30},
    "plants": {"is_active": True, "valid_to": END_OF_TIME},
    "event_types": {"default_reminder_days": 1, "color": "#007bff"},
    "events": {"is_completed": False},
    "reminders": {"is_sent": False, "is_completed": False},
}
NOW_COLUMNS = {
    "plant_types": ["created_at", "updated_at"],
    "plants": ["created_at", "updated_at", "valid_from"],
    "events": ["created_at", "updated_at"],
    "plant_images": ["upload_date"],
    "reminders": ["created_at"],
    "measurements": ["measurement_date"],
    "plants_history": ["changed_at"],
}


def append_rows(new: DataFrame, table: str, as_of) -> DataFrame:
    """SNK-1: fill the source's defaults (fixed values, then ``as_of`` for
    the "now" columns) into a batch of new rows."""
    now = as_ts(as_of)
    fills: dict[str, Column] = {}
    for c, v in DEFAULTS.get(table, {}).items():
        if c in new.columns:
            lit = as_ts(v) if c == "valid_to" else F.lit(v)
            fills[c] = F.coalesce(F.col(c), lit.cast(new.schema[c].dataType))
    for c in NOW_COLUMNS.get(table, []):
        if c in new.columns:
            fills[c] = F.coalesce(F.col(c), now.cast(new.schema[c].dataType))
    if table == "plants_history" and "changed_by" in new.columns:  # S-1
        fills["changed_by"] = F.coalesce(F.col("changed_by"), F.current_user())
    return new.withColumns(fills) if fills else new


def write_append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append a batch to a table folder (idempotence is the caller's: write
    each batch id once, e.g. from ``foreachBatch``)."""
    df.write.mode("append").format(fmt).save(path)


def normalise_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """SNK-6: a choice value of 0 means "not given" -> NULL."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in cols})


def touch_updated_at(df: DataFrame, as_of, col: str = "updated_at") -> DataFrame:
    """SNK-4: stamp rows of an update batch."""
    return df.withColumn(col, as_ts(as_of))


def apply_changes(
    current: DataFrame,
    changes: DataFrame,
    key: str = "id",
    time_col: str = "changed_at",
    seq_col: str = "seq",
) -> DataFrame:
    """SNK-2 (+ SNK-4): insert / update / delete batch -> new snapshot of the
    plants table.  The last change of a key (by time, then seq) wins; a final
    DELETE removes the key; updated rows get ``updated_at`` and a new
    ``valid_from`` = change time.  One aggregate (partial before the shuffle)
    and one full outer join - no per-key loop."""
    order = F.struct(F.col(time_col).isNull(), F.col(time_col), F.col(seq_col))
    payload = F.struct(*[F.col(c) for c in STATE_COLS + ["operation_type", time_col]])
    last = changes.groupBy(F.col(key).alias("_key")).agg(F.max_by(payload, order).alias("_c"))
    new = {c: F.col(f"_c.{c}") for c in STATE_COLS if c != "updated_at"}
    new |= {"updated_at": F.col(f"_c.{time_col}"), "valid_from": F.col(f"_c.{time_col}"), "valid_to": as_ts(END_OF_TIME)}
    joined = current.join(last, F.col(key) == F.col("_key"), "full_outer").where(
        F.col("_key").isNull() | (F.col("_c.operation_type") != "DELETE")
    )
    cols = [
        F.coalesce(F.col("_key"), F.col(key)).alias(key)
        if c == key
        else F.when(F.col("_key").isNotNull(), new[c].cast(current.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        for c in current.columns
    ]
    return joined.select(*cols)


def apply_table_changes(
    current: DataFrame,
    changes: DataFrame,
    key: str = "id",
    time_col: str = "changed_at",
    seq_col: str = "seq",
    op_col: str = "operation_type",
) -> DataFrame:
    """Edit and delete for any care table: a batch of changes -> new snapshot.

    The last change of a key (by time, then seq) wins.  A DELETE removes the
    row; an INSERT or UPDATE sets every column that the batch carries, columns
    it does not carry keep their value (NULL in a new row).  ``updated_at``
    becomes the change time where the table has it, ``created_at`` of a new
    row too.  One aggregate and one full outer join."""
    carried = [c for c in current.columns if c != key and c in changes.columns]
    order = F.struct(F.col(time_col).isNull(), F.col(time_col), F.col(seq_col))
    payload = F.struct(*carried, F.col(op_col).alias("_op"), F.col(time_col).alias("_at"))
    last = changes.groupBy(F.col(key).alias("_key")).agg(F.max_by(payload, order).alias("_c"))
    old = current.withColumn("_old", F.lit(True))
    joined = old.join(last, F.col(key) == F.col("_key"), "full_outer").where(
        F.col("_key").isNull() | (F.col("_c._op") != "DELETE")
    )
    touched, is_new = F.col("_key").isNotNull(), F.col("_old").isNull()
    cols = []
    for c in current.columns:
        value = F.col(c)
        if c == key:
            value = F.coalesce(F.col(key), F.col("_key"))
        elif c in carried:
            value = F.when(touched, F.col(f"_c.{c}").cast(current.schema[c].dataType)).otherwise(value)
        elif c == "updated_at":
            value = F.when(touched, F.col("_c._at")).otherwise(value)
        elif c == "created_at":
            value = F.when(is_new, F.col("_c._at")).otherwise(value)
        cols.append(value.alias(c))
    return joined.select(*cols)


def deleted_keys(changes: DataFrame, key: str = "id", time_col: str = "changed_at", seq_col: str = "seq") -> DataFrame:
    """Keys whose last change is a DELETE."""
    order = F.struct(F.col(time_col).isNull(), F.col(time_col), F.col(seq_col))
    last = changes.groupBy(key).agg(F.max_by("operation_type", order).alias("_op"))
    return last.where(F.col("_op") == "DELETE").select(key)


def cascade_delete(children: Mapping[str, DataFrame], deleted: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """SNK-3: drop the child rows (events, images, reminders, measurements)
    of deleted plants.  Anti-join on plant_id; the deleted-key set is not
    broadcast blindly (it grows with the data) - the planner picks."""
    ids = deleted.select(F.col(key).alias("plant_id")).distinct()
    return {name: df.join(ids, "plant_id", "left_anti") for name, df in children.items()}


def complete(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """SNK-5: set ``is_completed`` for the listed ids (bulk complete)."""
    from tendril.plans.quality import with_match_flag

    out = with_match_flag(rows, key, ids, key, "_done")
    return out.withColumn("is_completed", F.when(F.col("_done"), F.lit(True)).otherwise(F.col("is_completed"))).drop(
        "_done"
    )


def active_children(child: DataFrame, plants: DataFrame) -> DataFrame:
    """SNK-7 / F-1: rows of a child table whose plant is active."""
    return child.join(plants.where(F.col("is_active")).select(F.col("id").alias("plant_id")), "plant_id", "left_semi")


def write_snapshot(df: DataFrame, name: str, version: int) -> DataFrame:
    """Write a snapshot as a table under the shared checkpoint folder and read
    it back: cuts the lineage when change batches are applied one after the
    other (each version is its own folder, so a rerun overwrites only itself)."""
    from tendril.session import checkpoint_path

    path = f"{checkpoint_path(df.sparkSession, name)}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apply_change_batches(current: DataFrame, batches: Sequence[DataFrame], name: str = "snapshots") -> DataFrame:
    """SNK-2 over a sequence of change batches (e.g. one per day); every
    intermediate snapshot is written, so the plan stays one step deep."""
    snap = current
    for i, batch in enumerate(batches):
        snap = write_snapshot(apply_changes(snap, batch), name, i)
    return snap
