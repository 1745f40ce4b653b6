"""Storage layout for the care tables (the physical design for scale).

* Fact tables (events, reminders, measurements, images) are written
  partitioned by the month of their time column (``_month = 'yyyy-MM'``):
  look-back / look-ahead filters (last 30 days, next 7 days) prune to one or
  two month folders instead of reading the whole history.
* Inside a month the rows are range-partitioned and sorted by
  ``(plant_id, time)``, so parquet row-group statistics also skip data for
  per-plant lookups, and a hot plant's month is cut over several files.
* The SCD2 history is split into open and closed versions (``_open``): a
  lookup "as of now" reads only the open part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.functions.days import END_OF_TIME, add_days, as_ts
from tendril.sources.tables import CareTables

MONTH = "_month"
OPEN = "_open"
FACT_TIME = {
    "events": "event_date",
    "reminders": "reminder_date",
    "measurements": "measurement_date",
    "plant_images": "upload_date",
}
DIMENSIONS = ["plant_types", "plants", "event_types"]


def _month_of(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM"), F.lit("none"))


def write_tables(t: CareTables, path: str, files_per_month: int | None = None, mode: str = "overwrite") -> None:
    """Write the bundle under ``path/<table>`` in the layout above."""
    spark = t.spark
    n = files_per_month or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    for name in DIMENSIONS:
        getattr(t, name).write.mode(mode).parquet(f"{path}/{name}")
    for name, time_col in FACT_TIME.items():
        df = getattr(t, name).withColumn(MONTH, _month_of(F.col(time_col)))
        (
            df.repartitionByRange(n, MONTH, "plant_id", time_col)
            .sortWithinPartitions(MONTH, "plant_id", time_col)
            .write.mode(mode)
            .partitionBy(MONTH)
            .parquet(f"{path}/{name}")
        )
    if t.plants_history is not None:
        h = t.plants_history.withColumn(OPEN, F.col("valid_to") >= as_ts(END_OF_TIME))
        h.repartitionByRange(n, OPEN, "id", "valid_from").write.mode(mode).partitionBy(OPEN).parquet(
            f"{path}/plants_history"
        )


def since(df: DataFrame, time_col: str, start) -> DataFrame:
    """``time_col >= start``, plus the matching month-folder filter when the
    table carries the layout's month column (partition pruning)."""
    lo = as_ts(start)
    out = df.where(F.col(time_col) >= lo)
    if MONTH in df.columns:
        out = out.where(F.col(MONTH) >= F.date_format(lo, "yyyy-MM"))
    return out


def between(df: DataFrame, time_col: str, start, days: int) -> DataFrame:
    """``start <= time_col <= start + days`` with month-folder pruning."""
    lo = as_ts(start)
    hi = add_days(lo, days)
    out = df.where((F.col(time_col) >= lo) & (F.col(time_col) <= hi))
    if MONTH in df.columns:
        out = out.where(F.col(MONTH).between(F.date_format(lo, "yyyy-MM"), F.date_format(hi, "yyyy-MM")))
    return out


def largest_key_share(df: DataFrame, key: str) -> float:
    """Share of the rows held by the most frequent key (one partial aggregate;
    one number comes back to the driver)."""
    counts = df.groupBy(key).count()
    r = counts.agg(F.max("count").alias("m"), F.sum("count").alias("n")).first()
    return 0.0 if not r or not r.n else r.m / r.n


def save_bucketed(
    t: CareTables, database: str, buckets: int, mode: str = "overwrite", max_bucket_load: float = 2.0
) -> dict[str, bool]:
    """Catalog tables for co-located joins: plants bucketed by ``id`` and the
    fact tables bucketed by ``plant_id`` into the same number of buckets (and
    month-partitioned).  Per-plant aggregates and fact -> plant joins then
    read matching buckets and skip the shuffle.

    A bucketed scan reads each bucket in one task, so a hot plant would put
    its whole share into one task, where no shuffle (and no AQE skew split)
    can help.  A fact table whose largest plant holds more than
    ``max_bucket_load / buckets`` of its rows is therefore written without
    buckets (still month-partitioned and clustered); its plans shuffle, with
    AQE skew splitting.  Returns which tables were bucketed."""
    spark = t.spark
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    t.plants.write.mode(mode).bucketBy(buckets, "id").sortBy("id").saveAsTable(f"{database}.plants")
    for name in ("plant_types", "event_types"):
        getattr(t, name).write.mode(mode).saveAsTable(f"{database}.{name}")
    bucketed = {}
    for name, time_col in FACT_TIME.items():
        df = getattr(t, name).withColumn(MONTH, _month_of(F.col(time_col)))
        ok = largest_key_share(df, "plant_id") <= max_bucket_load / buckets
        if ok:
            w = df.write.bucketBy(buckets, "plant_id").sortBy("plant_id", time_col)
        else:  # clustered like write_tables: range partitions split the hot plant
            n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
            w = df.repartitionByRange(n, MONTH, "plant_id", time_col).sortWithinPartitions(
                MONTH, "plant_id", time_col
            ).write
        w.mode(mode).partitionBy(MONTH).saveAsTable(f"{database}.{name}")
        bucketed[name] = ok
    return bucketed


def load_catalog(spark, database: str) -> CareTables:
    """The care tables saved by ``save_bucketed``."""
    return CareTables(
        plant_types=spark.table(f"{database}.plant_types"),
        plants=spark.table(f"{database}.plants"),
        event_types=spark.table(f"{database}.event_types"),
        events=spark.table(f"{database}.events"),
        reminders=spark.table(f"{database}.reminders"),
        measurements=spark.table(f"{database}.measurements"),
        plant_images=spark.table(f"{database}.plant_images"),
    )
