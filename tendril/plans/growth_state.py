"""Growth figures from stored partial states that merge.

A state has a row per plant: counts, sums, extremes, and the first and last row with
their place in time.  States of disjoint batches merge into the state of all rows, so
a batch costs its own rows and the stored states of its plants; edits and deletions
rebuild the states of the plants they touch, and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.functions.days import add_days, as_ts
from tendril.operators.latest import time_order
from tendril.streaming.store import BucketStore

_SUMS = ["total_measurements", "_h_sum", "_h_n", "_w_n"]
_LEAST = ["first_measurement", "min_health_status"]
_MOST = ["last_measurement", "max_height_reached", "max_leaves_reached", "max_health_status"]
_ENDS = {"_first": False, "_last": True, "_w_first": False, "_w_last": True}


def growth_state(measurements: DataFrame, as_of, window_days: int = 30) -> DataFrame:
    """The state of a batch, for figures as of ``as_of``."""
    order = time_order("measurement_date")
    row = F.struct(order.alias("at"), F.struct("height_cm", "leaf_count", "health_status").alias("row"))
    inside = F.col("measurement_date") >= add_days(as_ts(as_of), -window_days)
    return measurements.where(F.col("plant_id").isNotNull()).groupBy("plant_id").agg(
        F.count("id").alias("total_measurements"),
        F.sum("health_status").alias("_h_sum"),
        F.count("health_status").alias("_h_n"),
        F.count_if(inside).alias("_w_n"),
        F.min("measurement_date").alias("first_measurement"),
        F.min("health_status").alias("min_health_status"),
        F.max("measurement_date").alias("last_measurement"),
        F.max("height_cm").alias("max_height_reached"),
        F.max("leaf_count").alias("max_leaves_reached"),
        F.max("health_status").alias("max_health_status"),
        F.min_by(row, order).alias("_first"),
        F.max_by(row, order).alias("_last"),
        F.min_by(row, F.when(inside, order)).alias("_w_first"),
        F.max_by(row, F.when(inside, order)).alias("_w_last"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """One state per plant from the states of disjoint batches."""

    def end(name: str, last: bool) -> Column:
        return (F.max_by if last else F.min_by)(F.col(name), F.col(f"{name}.at")).alias(name)

    merged = states.groupBy("plant_id").agg(
        *[F.sum(c).alias(c) for c in _SUMS],
        *[F.min(c).alias(c) for c in _LEAST],
        *[F.max(c).alias(c) for c in _MOST],
        *[end(name, last) for name, last in _ENDS.items()],
    )
    return merged.select(states.columns)


def stats_of(state: DataFrame) -> DataFrame:
    """A state in the shape of ``views.measurement_stats``."""
    return state.select(
        "plant_id", *_SUMS, *_LEAST, *_MOST,
        F.col("_first.row").alias("_first"), F.col("_last.row").alias("_last"),
        F.col("_w_first.row.height_cm").alias("_w_first"), F.col("_w_last.row.height_cm").alias("_w_last"),
    )


class GrowthStates:
    """States stored in buckets by plant; batches are numbered, a batch may run again."""

    def __init__(self, spark: SparkSession, base: str, as_of, window_days: int = 30, buckets: int = 64):
        self.store = BucketStore(spark, base, "plant_id", buckets)
        self.as_of, self.window_days = as_of, window_days

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Adds new measurements."""
        self.store.clean(batch_id)
        state = growth_state(batch, self.as_of, self.window_days)
        some = self.store.touched(state)
        if some:
            old = self.store.read(state.schema, some, batch_id)
            self.store.replace(merge_states(old.unionByName(state)), some, batch_id)

    def rebuild(self, plants: DataFrame, measurements: DataFrame, batch_id: int) -> None:
        """After edits or deletions: the states of ``plants(plant_id)`` anew from all their
        ``measurements``; a plant without any has no state any more."""
        self.store.clean(batch_id)
        ids = plants.where(F.col("plant_id").isNotNull()).select("plant_id").distinct()
        state = growth_state(measurements.join(ids, "plant_id", "left_semi"), self.as_of, self.window_days)
        some = self.store.touched(ids)
        if some:
            others = self.store.read(state.schema, some, batch_id).join(ids, "plant_id", "left_anti")
            self.store.replace(others.select(state.columns).unionByName(state), some, batch_id)

    def state(self, schema) -> DataFrame:
        return self.store.read(schema)
