"""Structured Streaming forms of the rules (ST-1 .. ST-7).

The source reacts to each row inside the writing transaction (triggers).
Here the same rules run on micro-batches:

* ST-1 / ST-2 are stateless: the batch rule applied to a stream (stream to
  static joins against the type catalogs and plants).
* ST-5 keeps the newest measurement per plant, as a streaming aggregate or as a
  stored table cut into buckets by plant.
* ST-3 and ST-6 need the previous row of a key, which windows cannot give on a
  stream (``lag`` is refused there): ``streaming.ordered`` keeps recent rows as
  state and gives a log of changes, with corrections for rows that come late.
* ST-4 keeps its change log and its table stored, cut into buckets by key
  (``streaming.store``): a micro-batch reads and rewrites only its buckets, so
  replays, late changes and any order of arrival are right.
* ST-7 drops replayed rows by id within a watermark (timestamp_ntz is cast
  to TIMESTAMP first; watermarks refuse NTZ columns).

Checkpoints and stored tables go under the shared folder named by
``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tendril.operators.latest import time_order
from tendril.plans import rules as R
from tendril.session import checkpoint_path
from tendril.sources.tables import CareTables
from tendril.streaming.ordered import HORIZON, in_order, net_rows  # noqa: F401
from tendril.streaming.store import BucketStore, rebuild

#: Buckets of a stored table (choose them so that one is some hundred megabytes).
BUCKETS = 64
#: Files of a micro-batch at most, unless a job says otherwise: a first
#: ``availableNow`` run then never holds a whole history at once.
FILES_PER_TRIGGER = 100


def read_stream(
    spark: SparkSession, path: str, schema: StructType, max_files_per_trigger: int | None = FILES_PER_TRIGGER
) -> DataFrame:
    r = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


# ------------------------------------------------------------------ ST-1/2
def stream_reminders(events: DataFrame, t: CareTables, as_of) -> DataFrame:
    """ST-1: new events -> reminders (RULE-1)."""
    return R.event_reminders(events, t, as_of)


def stream_health_warnings(measurements: DataFrame, t: CareTables, as_of) -> DataFrame:
    """ST-2: new measurements -> warnings (RULE-4)."""
    return R.health_warnings(measurements, t, as_of)


# ------------------------------------------------------------------ ST-5
def stream_latest(measurements: DataFrame) -> DataFrame:
    """ST-5: newest measurement per plant (run in update or complete mode)."""
    payload = F.struct("id", "measurement_date", "height_cm", "leaf_count", "health_status")
    return (
        measurements.groupBy("plant_id")
        .agg(F.max_by(payload, time_order("measurement_date")).alias("_l"))
        .select("plant_id", "_l.*")
    )


# ------------------------------------------------------------------ ST-7
def dedup_replays(df: DataFrame, id_col: str, time_col: str, delay: str = "1 day") -> DataFrame:
    """ST-7: drop rows whose id was already seen within the watermark."""
    return (
        df.withColumn("_event_time", F.col(time_col).cast("timestamp"))
        .withWatermark("_event_time", delay)
        .dropDuplicatesWithinWatermark([id_col])
        .drop("_event_time")
    )


# ------------------------------------------------------------------ ST-6
def stream_delta(measurements: DataFrame, horizon: str = HORIZON, wait: bool = False) -> DataFrame:
    """ST-6: growth since the previous measurement of the same plant (the streaming
    form of W-1 over rows with a height), as a log of changes: ``op`` 1 gives a
    row, -1 takes it back.  ``net_rows`` of it is the table."""
    m = measurements.where(F.col("height_cm").isNotNull())
    log = in_order(m, "plant_id", "measurement_date", "id", ["id", "measurement_date", "height_cm"], horizon, wait)
    return log.select(
        "op",
        "id",
        "plant_id",
        "measurement_date",
        "height_cm",
        F.col("prev_height_cm").alias("prev_height"),
        (F.col("height_cm") - F.col("prev_height_cm")).alias("height_growth"),
        "prev_measurement_date",
    )


# ------------------------------------------------------------------ ST-4
def _write_batch(df: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Write one batch's own folder (a re-run overwrites it) and read it back."""
    at = f"{path}/batch={batch_id}"
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def current_rows(spark: SparkSession, name: str, schema: StructType, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """The table that ``run_rebuilt`` maintains."""
    return BucketStore(spark, f"{checkpoint_path(spark, name)}/rows", key, buckets).read(schema)


def run_rebuilt(
    changes: DataFrame, build: Callable[[DataFrame], DataFrame], name: str, key: str = "id", seq: str = "seq",
    buckets: int = BUCKETS,
):
    """A stream of changes kept as the table ``build`` derives from them; changes may
    come late, out of order and more than once.  A micro-batch reads and rewrites
    the buckets of its keys only (``streaming.store``)."""
    spark = changes.sparkSession
    base = checkpoint_path(spark, name)

    def step(batch: DataFrame, batch_id: int) -> None:
        rebuild(batch.drop("batch"), batch_id, base, key, seq, build, buckets)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_path(spark, name + "_stream"))


def run_audit_stream(changes: DataFrame, name: str = "plant_history"):
    """ST-4: plant change feed -> history rows (the streaming TMP-3)."""
    from tendril.plans.temporal import audit_rows

    return run_rebuilt(changes, audit_rows, name)


def run_scd2_stream(changes: DataFrame, name: str = "plant_versions"):
    """ST-4: plant change feed -> SCD2 versions."""
    from tendril.plans.temporal import scd2_build

    return run_rebuilt(changes, scd2_build, name)


# ------------------------------------------------------------------ ST-3
def stream_completions(
    event_images: DataFrame, horizon: str = HORIZON, wait: bool = False, at: str | None = None
) -> DataFrame:
    """Completions (FALSE -> TRUE exactly) among the images ``(id, plant_id, event_type_id,
    event_date, is_completed, version)`` of events, as a log of changes.

    An event's images are ordered by version, whenever they arrive: one that comes
    late can make a completion or take one back.  The horizon is in the time ``at``
    of the images (which must grow with the version); without it the version counts
    as milliseconds."""
    order = F.col(at) if at else F.timestamp_millis(F.col("version").cast("long")).cast("timestamp_ntz")
    columns = ["plant_id", "event_type_id", "event_date", "is_completed"]
    log = in_order(event_images.withColumn("_order", order), "id", "_order", "version", columns, horizon, wait)
    done = log.where((F.col("prev_is_completed") == False) & (F.col("is_completed") == True))  # noqa: E712
    return done.select("op", "id", "plant_id", "event_type_id", "event_date")


def next_events_batch(done: DataFrame, t: CareTables, as_of) -> DataFrame:
    """RULE-3 on already detected transitions (old = FALSE for all of them)."""
    new = done.withColumn("is_completed", F.lit(True))
    old = done.select("id", F.lit(False).alias("is_completed")).distinct()
    return R.next_events(old, new, t, as_of)


def _per_op(log: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a rule makes of the given and of the taken back rows."""
    ops = [rule(log.where(F.col("op") == op).drop("op")).withColumn("op", F.lit(op)) for op in (1, -1)]
    return ops[0].unionByName(ops[1])


def run_next_events(
    event_images: DataFrame,
    t: CareTables,
    as_of,
    out_path: str,
    name: str = "next_events",
    reminders_path: str | None = None,
    horizon: str = HORIZON,
):
    """ST-3: transitions, then RULE-3 per micro-batch, as a log of changes in ``out_path``
    (``op`` 1: a new event, -1: one taken back), once per batch id: a re-run batch
    overwrites its own folder.  ``net_rows`` of it are the new events.  With
    ``reminders_path`` they also fire RULE-1, as in the source."""
    spark = t.spark
    log_path = checkpoint_path(spark, f"{name}_log")

    def write(batch: DataFrame, batch_id: int) -> None:
        log = _write_batch(batch, log_path, batch_id)  # the state is gone through once
        nxt = _write_batch(_per_op(log, lambda done: next_events_batch(done, t, as_of)), out_path, batch_id)
        if reminders_path:
            events = nxt.withColumnRenamed("source_event_id", "id")
            _write_batch(_per_op(events, lambda e: R.event_reminders(e, t, as_of)), reminders_path, batch_id)

    return (
        stream_completions(event_images, horizon)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint_path(spark, name))
    )


def to_parquet(stream: DataFrame, out_path: str, name: str, mode: str = "append", once: bool = False):
    """Start a stream into a parquet folder; its checkpoint lives under the
    shared ``spark.checkpoint.dir`` (``<dir>/<name>``), so a restarted or
    moved driver resumes exactly where it stopped."""
    w = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out_path)
        .option("checkpointLocation", checkpoint_path(stream.sparkSession, name))
    )
    if once:
        w = w.trigger(availableNow=True)
    return w.start()


def upsert_latest(snapshot: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Merge a batch of measurements into a latest-per-plant snapshot: per
    plant the newer of the stored row and the batch's newest row (same order
    as ``stream_latest``)."""
    fresh = stream_latest(batch)
    if snapshot is None:
        return fresh
    both = snapshot.unionByName(fresh)
    payload = F.struct(*[F.col(c) for c in fresh.columns if c != "plant_id"])
    return (
        both.groupBy("plant_id")
        .agg(F.max_by(payload, time_order("measurement_date")).alias("_l"))
        .select("plant_id", "_l.*")
    )


def run_latest_snapshot(measurements: DataFrame, name: str = "latest_snapshot", buckets: int = BUCKETS):
    """ST-5 as a maintained table, cut into buckets by plant: a micro-batch reads and
    rewrites the buckets of its plants only; a re-run batch writes the same again.
    ``latest_snapshot`` reads it."""
    spark = measurements.sparkSession
    store = BucketStore(spark, checkpoint_path(spark, name), "plant_id", buckets)

    def step(batch: DataFrame, batch_id: int) -> None:
        store.clean(batch_id)
        fresh = stream_latest(batch)
        some = store.touched(fresh)
        if some:
            store.replace(upsert_latest(store.read(fresh.schema, some, batch_id), batch), some, batch_id)

    return measurements.writeStream.foreachBatch(step).option(
        "checkpointLocation", checkpoint_path(spark, name + "_stream")
    )


def latest_snapshot(spark: SparkSession, schema: StructType, name: str = "latest_snapshot", buckets: int = BUCKETS) -> DataFrame:
    return BucketStore(spark, checkpoint_path(spark, name), "plant_id", buckets).read(schema)
