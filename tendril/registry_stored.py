"""Registered queries over stored forms (ranked lists, trigram index, snapshots, states)
and over streams of the given rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.operators.ranking import PLACE, dense_table_rows, ranked
from tendril.operators.paging import seek_order
from tendril.operators.trigrams import build_index, search
from tendril.plans import changes as C
from tendril.plans import quality as Q
from tendril.plans import rules as R
from tendril.plans import temporal as TM
from tendril.plans import views as V
from tendril.plans.diff import snapshot_diff
from tendril.plans.growth_state import GrowthStates, growth_state, stats_of
from tendril.registry import EV, MS, ORACLE, QUERIES, T, register
from tendril.registry_temporal import LAST_CHANGE_SQL, RULE1_SQL
from tendril.registry_views import GROWTH_STATS_SQL
from tendril.session import checkpoint_path
from tendril.sources.roles import EVENTS_AS_OF, MEASURE_AS_OF
from tendril.streaming import jobs as S

# ---------------------------------------------------------------- lists and ids
PAGE = 20


@register(
    "measurement_deep_page",
    f"""
WITH listed AS (SELECT *, row_number() OVER (ORDER BY measurement_date IS NULL DESC, measurement_date DESC, id DESC) AS place,
                       count(*) OVER () AS total FROM measurements)
SELECT place, id, plant_id, measurement_date, height_cm FROM listed
WHERE place > (total * 3 // 4 // {PAGE}) * {PAGE} AND place <= (total * 3 // 4 // {PAGE} + 1) * {PAGE}""",
)
def q_measurement_deep_page(spark, sf_dir):
    m = T(spark, sf_dir).measurements.select("id", "plant_id", "measurement_date", "height_cm")
    listed = ranked(m, seek_order(["measurement_date", "id"]))
    page = listed.page(listed.total * 3 // 4 // PAGE + 1, PAGE)
    return page.select(F.col(PLACE).alias("place"), "id", "plant_id", "measurement_date", "height_cm")


@register(
    "reminders_with_dense_ids",
    f"""
WITH top AS (SELECT max(id) AS id FROM reminders),
made AS (SELECT * FROM ({RULE1_SQL.format(now=EV, src="care_events")}))
FROM reminders
UNION ALL BY NAME
SELECT top.id + row_number() OVER (ORDER BY source_event_id) AS id, plant_id, event_type_id, reminder_date, message,
       is_sent, is_completed, created_at FROM made, top""",
)
def q_reminders_with_dense_ids(spark, sf_dir):
    t = T(spark, sf_dir)
    made = R.event_reminders(t.events, t, EVENTS_AS_OF)
    return t.reminders.unionByName(dense_table_rows(made, t.reminders, [F.col("source_event_id")]))


# ----------------------------------------------------------------------- search
@register(
    "name_search_batch",
    """
WITH needles AS (SELECT DISTINCT needle FROM (
  SELECT right(name, 4) AS needle FROM plants WHERE id % 100 = 0
  UNION ALL FROM (VALUES ('#0'), ('7'), ('%9_1'), (''), ('nobody'), (NULL))) WHERE needle IS NOT NULL)
SELECT needle, p.id FROM needles JOIN plants p ON p.name LIKE '%' || needle || '%'""",
)
def q_name_search_batch(spark, sf_dir):
    plants = T(spark, sf_dir).plants
    asked = plants.where(F.col("id") % 100 == 0).select(F.right("name", F.lit(4)).alias("needle"))
    fixed = spark.createDataFrame([("#0",), ("7",), ("%9_1",), ("",), ("nobody",), (None,)], "needle string")
    return search(build_index(plants, "id", "name"), plants, "id", "name", asked.unionByName(fixed))


# -------------------------------------------------------------------- snapshots
@register(
    "plants_snapshot_changes",
    f"""
WITH last AS ({LAST_CHANGE_SQL}),
fresh AS (
  SELECT p.id, p.location, p.updated_at FROM plants p WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.id = p.id)
  UNION ALL SELECT id, location, changed_at FROM last WHERE operation_type <> 'DELETE'),
paired AS (SELECT coalesce(p.id, f.id) AS id, p.id AS old_id, f.id AS new_id, p.location AS old_location, f.location AS new_location,
                p.updated_at AS old_updated_at, f.updated_at AS new_updated_at
         FROM plants p FULL JOIN fresh f ON p.id = f.id)
SELECT id, CASE WHEN old_id IS NULL THEN 'INSERT' WHEN new_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation_type,
       old_location, new_location
FROM paired
WHERE old_id IS NULL OR new_id IS NULL OR old_location IS DISTINCT FROM new_location
      OR old_updated_at IS DISTINCT FROM new_updated_at""",
)
def q_plants_snapshot_changes(spark, sf_dir):
    t = T(spark, sf_dir)
    seen = ["id", "location", "updated_at"]
    diff = snapshot_diff(t.plants.select(seen), C.apply_changes(t.plants, t.plant_changes).select(seen))
    return diff.select("id", "operation_type", F.col("old.location").alias("old_location"), F.col("new.location").alias("new_location"))


@register(
    "growth_statistics_merged",
    "WITH kept AS (SELECT * FROM measurements WHERE id % 10 <> 0),\n"
    + GROWTH_STATS_SQL.format(now=MS, days=30).replace("FROM measurements", "FROM kept").strip().removeprefix("WITH "),
)
def q_growth_statistics_merged(spark, sf_dir):
    """Three slices of time added one after the other, then a batch of deletions."""
    t = T(spark, sf_dir)
    m, date = t.measurements, F.col("measurement_date")
    states = GrowthStates(spark, checkpoint_path(spark, f"growth-{uuid.uuid4().hex}"), MEASURE_AS_OF, buckets=8)
    early, late = F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")
    for k, part in enumerate([date < early, (date >= early) & (date < late), (date >= late) | date.isNull()]):
        states.add(m.where(part), k)
    gone = F.col("id") % 10 == 0
    states.rebuild(m.where(gone).select("plant_id"), m.where(~gone), 3)
    state = states.state(growth_state(m, MEASURE_AS_OF).schema)
    return V.growth_statistics(t, MEASURE_AS_OF, stats=stats_of(state))


@register(
    "quarantine_counts",
    """
WITH m AS (SELECT plant_id IS NULL AS no_plant, NOT health_status BETWEEN 1 AND 5 AS health, NOT height_cm BETWEEN 0 AND 999.99 AS height,
                  NOT width_cm BETWEEN 0 AND 999.99 AS width, NOT leaf_count BETWEEN 0 AND 9999 AS leaves,
                  NOT flower_count BETWEEN 0 AND 9999 AS flowers FROM measurements)
SELECT 'rows' AS counted, count(*) AS n FROM m
UNION ALL SELECT 'rejected', count(*) FROM m WHERE no_plant OR health OR height OR width OR leaves OR flowers
UNION ALL SELECT 'not_null:plant_id', count(*) FROM m WHERE no_plant
UNION ALL SELECT 'range:health_status', count(*) FROM m WHERE health
UNION ALL SELECT 'range:height_cm', count(*) FROM m WHERE height
UNION ALL SELECT 'range:width_cm', count(*) FROM m WHERE width
UNION ALL SELECT 'range:leaf_count', count(*) FROM m WHERE leaves
UNION ALL SELECT 'range:flower_count', count(*) FROM m WHERE flowers""",
)
def q_quarantine_counts(spark, sf_dir):
    at = checkpoint_path(spark, f"quarantine-{uuid.uuid4().hex}")
    counts = Q.write_quarantined(T(spark, sf_dir).measurements, Q.measurement_rules(), at)
    return spark.createDataFrame(sorted(counts.items()), "counted string, n long")


# ---------------------------------------------------------------------- streams
def _stream(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a stream of stored files in no order of time, two micro-batches, and a
    folder for its results."""
    spark = df.sparkSession
    base = checkpoint_path(spark, f"given-{uuid.uuid4().hex}")
    df.repartition(4, F.xxhash64("id")).write.option("maxRecordsPerFile", 0).parquet(f"{base}/in")
    files = len(spark.read.parquet(f"{base}/in").inputFiles())
    return S.read_stream(spark, f"{base}/in", df.schema, max(1, -(-files // 2))), base


def _to_end(stream: DataFrame, base: str) -> DataFrame:
    S.to_parquet(stream, f"{base}/out", f"{base.rsplit('/', 1)[1]}/checkpoint", once=True).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def _same_as(name: str, batch_query: str):
    """Registers a stream whose result is that of a batch query."""

    def deco(fn):
        QUERIES[name] = fn
        ORACLE[name] = ORACLE[batch_query]
        return fn

    return deco


@_same_as("stream_event_reminders", "event_reminders")
def q_stream_event_reminders(spark, sf_dir):
    t = T(spark, sf_dir)
    events, base = _stream(t.events)
    return _to_end(S.stream_reminders(events, t, EVENTS_AS_OF), base)


@_same_as("stream_health_warnings", "health_warnings")
def q_stream_health_warnings(spark, sf_dir):
    t = T(spark, sf_dir)
    measurements, base = _stream(t.measurements)
    return _to_end(S.stream_health_warnings(measurements, t, MEASURE_AS_OF), base)


@_same_as("stream_plant_versions", "scd2_versions")
def q_stream_plant_versions(spark, sf_dir):
    changes, base = _stream(T(spark, sf_dir).plant_changes)
    name = f"{base.rsplit('/', 1)[1]}/versions"
    S.run_rebuilt(changes, TM.scd2_build, name, buckets=8).trigger(availableNow=True).start().awaitTermination()
    return S.current_rows(spark, name, TM.scd2_build(T(spark, sf_dir).plant_changes).schema, buckets=8)


@register(
    "stream_latest_measurements",
    """
SELECT plant_id, id, measurement_date, height_cm, leaf_count, health_status
FROM (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY measurement_date IS NULL DESC, measurement_date DESC, id DESC) AS rn
      FROM measurements) m WHERE rn = 1""",
)
def q_stream_latest_measurements(spark, sf_dir):
    t = T(spark, sf_dir)
    measurements, base = _stream(t.measurements)
    name = f"{base.rsplit('/', 1)[1]}/latest"
    S.run_latest_snapshot(measurements, name, 8).trigger(availableNow=True).start().awaitTermination()
    return S.latest_snapshot(spark, S.stream_latest(t.measurements).schema, name, 8)


@register(
    "stream_growth_deltas",
    """
SELECT id, plant_id, measurement_date, height_cm, lag(height_cm) OVER w AS prev_height, height_cm - lag(height_cm) OVER w AS height_growth,
       lag(measurement_date) OVER w AS prev_measurement_date
FROM measurements WHERE height_cm IS NOT NULL
WINDOW w AS (PARTITION BY plant_id ORDER BY measurement_date IS NULL, measurement_date, id)""",
)
def q_stream_growth_deltas(spark, sf_dir):
    measurements, base = _stream(T(spark, sf_dir).measurements)
    return S.net_rows(_to_end(S.stream_delta(measurements), base))


@register(
    "stream_without_replays",
    "SELECT id, plant_id, measurement_date, height_cm, leaf_count FROM measurements",
)
def q_stream_without_replays(spark, sf_dir):
    m = T(spark, sf_dir).measurements.select("id", "plant_id", "measurement_date", "height_cm", "leaf_count")
    twice, base = _stream(m.unionByName(m))
    return _to_end(S.dedup_replays(twice, "id", "measurement_date", "3650 days"), base)
