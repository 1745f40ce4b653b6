"""Ordered neighbours per key, safe under key skew (W-1 .. W-5, TMP-1, TMP-3).

``LAG``/``LEAD``/``ROW_NUMBER`` over ``PARTITION BY key`` put every row of a
key into one task.  When one plant holds a third of all rows that task gets a
third of the data.  The operators here cut such keys by *row counts*:

1. One aggregate over the key column finds the hot keys, those with more than
   ``target_rows`` rows.  At most ``MAX_HOT_KEYS`` are taken, the largest, so
   their list is bounded whatever the data; it is stored in the shared
   checkpoint folder and broadcast.
2. Rows of all other keys take the plain plan: windows per key, one shuffle.
3. Rows of hot keys are range-partitioned by (key, order) into parts of about
   half the target and stored with their part number.  The order is total (it
   ends with the id), so bursts at one instant, stray dates and rows without a
   time are cut like any others.  Storing them once means that every later
   step, and every recomputed task, sees the same parts.
4. The windows run per (key, part).  Only the first and last row of a part
   need a value from another part: one row per (hot key, part) is aggregated
   and handed on to its neighbours by a small window, then joined back.

The result equals the plain window result exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendril.session import ensure_checkpoint_dir

DEFAULT_TARGET_ROWS = 2_000_000
TARGET_ROWS_CONF = "spark.tendril.skew.targetRows"  # session setting, rows per key above which a key is split
#: Hot keys that are split at most, the largest first: each further key has
#: less than a 100,000th of all rows.  Bounds every broadcast here.
MAX_HOT_KEYS = 100_000
PART = "_part"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _target(df: DataFrame, target_rows: int | None) -> int:
    if target_rows:
        return int(target_rows)
    return int(df.sparkSession.conf.get(TARGET_ROWS_CONF, str(DEFAULT_TARGET_ROWS)))


def _stored(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_keys(df: DataFrame, key: str, target_rows: int) -> DataFrame:
    """``_hk, _n``: the keys with more than ``target_rows`` rows, at most MAX_HOT_KEYS
    of them (a NULL key counts as a key), stored."""
    counts = df.groupBy(F.col(key).alias("_hk")).agg(F.count(F.lit(1)).alias("_n"))
    return _stored(counts.where(F.col("_n") > target_rows).orderBy(F.desc("_n"), "_hk").limit(MAX_HOT_KEYS))


def split_hot(
    df: DataFrame, key: str, order: Sequence[str], target_rows: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, stored rows of hot keys with their ``_part`` or None).

    Parts are numbered along (key, order) and hold at most about
    ``target_rows`` rows each; rows of one key and part lie in one partition."""
    target_rows = _target(df, target_rows)
    hot = hot_keys(df, key, target_rows)
    rows = hot.agg(F.sum("_n").alias("n")).first()["n"]
    if not rows:
        return df, None
    keys = F.broadcast(hot.select("_hk"))
    same = F.col(key).eqNullSafe(F.col("_hk"))
    parts = max(1, -(-2 * rows // target_rows))
    ranged = df.join(keys, same, "left_semi").repartitionByRange(parts, F.col(key), *[F.col(o) for o in order])
    return df.join(keys, same, "left_anti"), _stored(ranged.withColumn(PART, F.spark_partition_id()))


def _neighbours(
    df: DataFrame, parts: list[str], ords: list[str], payload: Column, prev: bool, next_: bool, rank: bool
) -> DataFrame:
    """Adds ``_lag``, ``_lead``, ``_rn`` and ``_cnt`` within ``parts`` as far as asked for."""
    w = Window.partitionBy(*parts).orderBy(*ords)
    out = df
    if prev:
        out = out.withColumn("_lag", F.lag(payload).over(w))
    if next_:
        out = out.withColumn("_lead", F.lead(payload).over(w))
    if rank:
        out = out.withColumn("_rn", F.row_number().over(w)).withColumn(
            "_cnt", F.count(F.lit(1)).over(Window.partitionBy(*parts))
        )
    return out


def with_neighbours(
    df: DataFrame,
    key: str,
    order: Sequence[Column | str],
    values: Sequence[str],
    time_col: str,
    prev: bool = True,
    next_: bool = False,
    rank_desc: str | None = None,
    prev_prefix: str = "prev_",
    next_prefix: str = "next_",
    target_rows: int | None = None,
) -> DataFrame:
    """Add ``prev_<v>`` / ``next_<v>`` (the adjacent row of the same key under
    ``order``) and optionally a descending row number ``rank_desc``.

    ``order`` is a list of columns or expressions (NULL times last) and total
    (break ties by ``id``, of any orderable type).
    """
    ords = [f"_o{i}" for i in range(len(order))]
    base = df.select("*", *[_col(o).alias(n) for o, n in zip(order, ords)])
    payload = F.struct(*[F.col(v).alias(v) for v in values])
    cold, hot = split_hot(base, key, ords, target_rows)
    names = [c for c, on in (("_lag", prev), ("_lead", next_), ("_rank", bool(rank_desc))) if on]

    def shaped(part: DataFrame) -> DataFrame:
        if rank_desc:
            part = part.withColumn("_rank", (F.col("_cnt") - F.col("_rn") + 1).cast("int"))
        return part.select(*[F.col(c) for c in df.columns], *names)

    out = shaped(_neighbours(cold, [key], ords, payload, prev, next_, bool(rank_desc)))
    if hot is not None:
        local = _neighbours(hot, [key, PART], ords, payload, prev, next_, True)
        at = F.struct(*[F.col(n) for n in ords])
        edges = hot.groupBy(key, PART).agg(
            F.min_by(payload, at).alias("_head"), F.max_by(payload, at).alias("_tail"), F.count(F.lit(1)).alias("_n")
        )
        along = Window.partitionBy(key).orderBy(PART)
        behind = F.sum("_n").over(along.rowsBetween(1, Window.unboundedFollowing))
        edges = edges.select(
            F.col(key).alias("_ek"),
            F.col(PART).alias("_ep"),
            F.lag("_tail").over(along).alias("_before"),
            F.lead("_head").over(along).alias("_after"),
            F.coalesce(behind, F.lit(0)).alias("_behind"),
        )
        # one row per (hot key, part); the planner picks the join, the rows are already dealt by it
        local = local.join(edges, F.col(key).eqNullSafe(F.col("_ek")) & (F.col(PART) == F.col("_ep")), "left")
        if prev:
            local = local.withColumn("_lag", F.when(F.col("_rn") == 1, F.col("_before")).otherwise(F.col("_lag")))
        if next_:
            last = F.col("_rn") == F.col("_cnt")
            local = local.withColumn("_lead", F.when(last, F.col("_after")).otherwise(F.col("_lead")))
        out = out.unionByName(shaped(local.withColumn("_cnt", F.col("_cnt") + F.col("_behind"))))

    adds = [F.col("_lag")[v].alias(prev_prefix + v) for v in values if prev]
    adds += [F.col("_lead")[v].alias(next_prefix + v) for v in values if next_]
    if rank_desc:
        adds.append(F.col("_rank").alias(rank_desc))
    return out.select(*[F.col(c) for c in df.columns], *adds)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    right_cols: Sequence[str],
    right_order: str | None = None,
    prefix: str = "",
    target_rows: int | None = None,
) -> DataFrame:
    """For every left row, the values of the last right row of the same key
    with ``right_time <= left_time`` (NULL if none); every left row is kept
    exactly once.

    Runs as one ordered scan over the union of both sides - no pairs are ever
    formed, so a key with many versions and many facts costs linear work.  A
    right row at the same time as a left row counts as before it; right rows
    at one time are ordered by ``right_order`` (of any orderable type).
    Skew-safe through the same parts as ``with_neighbours``; left rows of one
    instant, which have no order among themselves, are cut by a hash.
    """
    lcols = left.columns
    tie_type = right.schema[right_order].dataType if right_order else "long"
    l_part = left.select(
        F.struct(*[F.col(c) for c in lcols]).alias("_left"),
        F.col(key).alias("_k"),
        F.col(left_time).alias("_t"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(tie_type).alias("_tie"),
    )
    tie = F.col(right_order) if right_order else F.lit(None).cast("long")
    r_part = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(key).alias("_k"),
        F.col(right_time).alias("_t"),
        F.lit(0).alias("_side"),
        tie.alias("_tie"),
        F.struct(*[F.col(c).alias(c) for c in right_cols]).alias("_right"),
    )
    l_part = l_part.withColumn("_right", F.lit(None).cast(r_part.schema["_right"].dataType))
    r_part = r_part.withColumn("_left", F.lit(None).cast(l_part.schema["_left"].dataType))
    both = l_part.unionByName(r_part).select(
        "*", F.col("_t").isNull().alias("_late"), F.xxhash64("_left").alias("_hash")
    )
    ords = ["_late", "_t", "_side", "_tie", "_hash"]
    cold, hot = split_hot(both, "_k", ords, target_rows)

    def carried(part: DataFrame, parts: list[str]) -> DataFrame:
        upto = Window.partitionBy(*parts).orderBy(*ords[:-1]).rowsBetween(Window.unboundedPreceding, 0)
        return part.withColumn("_carry", F.last("_right", ignorenulls=True).over(upto)).where(F.col("_side") == 1)

    out = carried(cold, ["_k"]).select("_left", "_t", "_carry")
    if hot is not None:
        # into each part: the last right row of all earlier parts of the key
        at = F.when(F.col("_side") == 0, F.struct("_t", "_tie"))
        last = hot.groupBy("_k", PART).agg(F.max_by("_right", at).alias("_last"))
        earlier = Window.partitionBy("_k").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        entry = last.select(
            F.col("_k").alias("_ck"),
            F.col(PART).alias("_cp"),
            F.last("_last", ignorenulls=True).over(earlier).alias("_entry"),
        )
        local = carried(hot, ["_k", PART]).join(
            entry, F.col("_k").eqNullSafe(F.col("_ck")) & (F.col(PART) == F.col("_cp")), "left"
        )
        out = out.unionByName(local.select("_left", "_t", F.coalesce("_carry", "_entry").alias("_carry")))
    value = F.when(F.col("_t").isNotNull(), F.col("_carry"))
    return out.select(
        *[F.col("_left")[c].alias(c) for c in lcols],
        *[value[c].alias(prefix + c) for c in right_cols],
    )
