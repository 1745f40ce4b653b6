"""Temporal (SCD type 2) operators: TMP-1 .. TMP-3, FN-2, FN-3, FN-20.

The source keeps a current table plus a history table filled by an AFTER
trigger.  As written, that trigger re-fires on its own UPDATE and leaves
INSERT audit rows open forever, so a point-in-time lookup can return a plant
twice.  These operators build the stated intent instead: one version per key
and instant, half-open ``[valid_from, valid_to)``, and the audit rows a single
(non-nested) trigger firing per change would write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.functions import labels as L
from tendril.functions.days import END_OF_TIME, as_ts
from tendril.operators.sequence import asof_join, with_neighbours

STATE_COLS = ["name", "plant_type_id", "planted_date", "location", "notes", "is_active", "created_at", "updated_at"]
AUDIT_COLS = ["operation_type", "changed_by", "changed_at", "seq"]


def _change_order(time_col: str, seq_col: str):
    return [F.col(time_col).isNull(), F.col(time_col), F.col(seq_col)]


def scd2_build(changes: DataFrame, key: str = "id", time_col: str = "changed_at", seq_col: str = "seq") -> DataFrame:
    """TMP-1: change feed (INSERT/UPDATE/DELETE, new image per change) ->
    versions.  Each non-DELETE change opens a version at its time that lasts
    until the key's next change (by time, then seq) or the end of time; a
    DELETE only closes.  Equal times give a zero-length version no instant hits."""
    n = with_neighbours(
        changes, key, _change_order(time_col, seq_col), [time_col], time_col, prev=False, next_=True
    )
    return n.where(F.col("operation_type") != "DELETE").select(
        key,
        *STATE_COLS,
        F.col(time_col).alias("valid_from"),
        F.coalesce(F.col("next_" + time_col), as_ts(END_OF_TIME)).alias("valid_to"),
        *AUDIT_COLS,
    )


def as_of_lookup(versions: DataFrame, t) -> DataFrame:
    """TMP-2 / FN-3: the state of every key at instant ``t``
    (``valid_from <= t < valid_to``)."""
    at = as_ts(t)
    return versions.where((F.col("valid_from") <= at) & (F.col("valid_to") > at)).select(
        "id", "name", "plant_type_id", "location", "notes", "valid_from", "valid_to"
    )


def temporal_join(
    facts: DataFrame,
    versions: DataFrame,
    fact_key: str,
    fact_time: str,
    cols: list[str],
    prefix: str = "at_",
) -> DataFrame:
    """TMP-2 per row: every fact gets ``cols`` of the version of its key that
    was valid at the fact's time (NULL if none).  An as-of scan, not an
    equi-join plus range filter, so no (fact x version) pairs are formed."""
    v = versions.select(F.col("id").alias(fact_key), "valid_from", "valid_to", "seq", *cols)
    j = asof_join(facts, v, fact_key, fact_time, "valid_from", cols + ["valid_to"], right_order="seq", prefix="_v_")
    live = F.col("_v_valid_to") > F.col(fact_time)
    return j.select(
        *[F.col(c) for c in facts.columns],
        *[F.when(live, F.col("_v_" + c)).alias(prefix + c) for c in cols],
    )


def audit_rows(changes: DataFrame, key: str = "id", time_col: str = "changed_at", seq_col: str = "seq") -> DataFrame:
    """TMP-3: the history rows as the trigger writes them, one per change:
    INSERT -> the new image, open; UPDATE / DELETE -> the old image (the
    previous change's), closed at the change time."""
    n = with_neighbours(
        changes, key, _change_order(time_col, seq_col), STATE_COLS + [time_col], time_col, prev=True
    )
    is_insert = F.col("operation_type") == "INSERT"
    state = [F.when(is_insert, F.col(c)).otherwise(F.col("prev_" + c)).alias(c) for c in STATE_COLS]
    return n.select(
        key,
        *state,
        F.when(is_insert, F.col(time_col)).otherwise(F.col("prev_" + time_col)).alias("valid_from"),
        F.when(is_insert, as_ts(END_OF_TIME)).otherwise(F.col(time_col)).alias("valid_to"),
        *AUDIT_COLS,
    )


def plant_history(history: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """FN-2: the change log (of the given plants, else of all)."""
    h = history if ids is None else history.join(ids, "id", "left_semi")
    return h.select("id", "name", "location", "valid_from", "valid_to", "operation_type", "changed_at", "seq")


def plant_history_order():
    return [F.col("changed_at").desc_nulls_first(), F.col("seq").desc()]


def history_labeled(history: DataFrame) -> DataFrame:
    """FN-20 rows: operation label and whether the interval is closed."""
    return plant_history(history).select(
        "*",
        L.operation_label("operation_type").alias("operation_label"),
        (F.year("valid_to") < 9999).alias("is_closed"),
    )


def history_summary(history: DataFrame) -> DataFrame:
    """FN-20 / A-11: per plant the number of changes, newest change, and
    counts by operation and of closed intervals."""
    op = F.col("operation_type")
    return history.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_changes"),
        F.max("changed_at").alias("last_change"),
        F.count_if(op == "INSERT").alias("n_inserts"),
        F.count_if(op == "UPDATE").alias("n_updates"),
        F.count_if(op == "DELETE").alias("n_deletes"),
        F.count_if(F.year("valid_to") < 9999).alias("n_closed"),
    )


def point_in_time(current: DataFrame, history: DataFrame, t) -> DataFrame:
    """U-3: the source's point-in-time function as written - current rows
    valid at ``t`` UNION ALL history rows valid at ``t``.  With history rows
    as the trigger writes them (``audit_rows``), a never-changed plant can be
    found twice; ``as_of_lookup`` on ``scd2_build`` versions is the exact form."""
    at = as_ts(t)
    cols = ["id", "name", "plant_type_id", "location", "notes"]
    valid = (F.col("valid_from") <= at) & (F.col("valid_to") > at)
    return current.where(valid).select(*cols).unionByName(history.where(valid).select(*cols))
