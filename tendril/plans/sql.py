"""SQL surface for ``spark.sql``: the views as temporary views at a fixed time,
the table functions as Spark SQL functions with parameters and defaults."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.operators.latest import latest_per_key
from tendril.plans import analytics as A
from tendril.plans import temporal as TM
from tendril.plans import views as V
from tendril.sources.tables import CareTables


def register_views(spark: SparkSession, t: CareTables, as_of, prefix: str = "v_") -> list[str]:
    """Create ``v_*`` temp views for the care tables' views at ``as_of``."""
    views = {
        "plants_overview": V.plants_overview(t, as_of),
        "events_detailed": V.events_detailed(t, as_of),
        "plant_type_stats": V.plant_type_stats(t, as_of),
        "plant_growth_timeline": V.growth_timeline(t),
        "active_reminders": V.active_reminders(t, as_of),
        "calendar_events": V.calendar(t),
        "measurements_overview": V.measurements_overview(t, as_of),
        "growth_statistics": V.growth_statistics(t, as_of),
        "health_alerts": V.health_alerts(t, as_of),
        "active_plants": A.active_plants(t, as_of),
        "plants_needing_attention": A.needs_attention(t, as_of),
        "upcoming_reminders": A.upcoming_reminders(t, as_of),
        "plants_health_analysis": A.health_analysis(t, as_of),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    for name, df in {"plants": t.plants, "events": t.events, "measurements": t.measurements,
                     "reminders": t.reminders, "plant_types": t.plant_types, "event_types": t.event_types,
                     "plant_images": t.plant_images}.items():
        df.createOrReplaceTempView(name)
    return [prefix + n for n in views]


# ------------------------------------------------------- table functions
#: The day rules of the functions (see ``plans.analytics``).
_FUNCTIONS = {
    "active_plants": (
        "",
        "id BIGINT, name STRING, plant_type_name STRING, planted_date DATE, location STRING, "
        "days_since_planted INT, created_at TIMESTAMP_NTZ",
        """SELECT p.id, p.name, y.name, p.planted_date, p.location,
                  datediff(CAST(active_plants.as_of AS DATE), p.planted_date), p.created_at
           FROM {p}plants p LEFT JOIN {p}plant_types y ON p.plant_type_id = y.id
           WHERE p.is_active""",
    ),
    "plant_history": (
        "plant_id BIGINT",
        "id BIGINT, name STRING, location STRING, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ, "
        "operation_type STRING, changed_at TIMESTAMP_NTZ",
        """SELECT h.id, h.name, h.location, h.valid_from, h.valid_to, h.operation_type, h.changed_at
           FROM {p}plant_history h WHERE h.id = plant_history.plant_id""",
    ),
    "plant_at_time": (
        "plant_id BIGINT, at TIMESTAMP_NTZ",
        "id BIGINT, name STRING, plant_type_id BIGINT, location STRING, notes STRING",
        """SELECT s.id, s.name, s.plant_type_id, s.location, s.notes FROM {p}plant_states s
           WHERE s.id = plant_at_time.plant_id
             AND s.valid_from <= plant_at_time.at AND s.valid_to > plant_at_time.at""",
    ),
    "growth_stats": (
        "plant_id BIGINT",
        "plant_id BIGINT, plant_name STRING, total_measurements INT, first_measurement_date TIMESTAMP_NTZ, "
        "last_measurement_date TIMESTAMP_NTZ, current_height_cm DOUBLE, max_height_cm DOUBLE, height_growth_cm DOUBLE, "
        "current_leaf_count INT, max_leaf_count INT, current_health_status INT, avg_health_status DOUBLE",
        "SELECT g.* FROM {p}growth g WHERE g.plant_id = growth_stats.plant_id",
    ),
    "needs_attention": (
        "",
        "plant_id BIGINT, plant_name STRING, reason STRING, urgency INT, last_event_date TIMESTAMP_NTZ",
        """SELECT w.plant_id, w.plant_name, concat('Not watered for ', w.days, ' days'),
                  CASE WHEN w.days > 14 THEN 3 WHEN w.days > 7 THEN 2 ELSE 1 END, w.last_water
           FROM (SELECT c.*, CAST(extract(DAY FROM needs_attention.as_of - coalesce(c.last_water, c.created_at)) AS INT) AS days
                 FROM {p}watering c) w
           WHERE w.days > 5
           UNION ALL
           SELECT h.plant_id, h.plant_name, concat('Poor health - ', h.health_status, '/5'),
                  CASE WHEN h.health_status <= 2 THEN 3 WHEN h.health_status = 3 THEN 2 ELSE 1 END, h.measurement_date
           FROM {p}newest_health h WHERE h.health_status <= 3""",
    ),
    "upcoming_reminders": (
        "days_ahead INT DEFAULT 7",
        "reminder_id BIGINT, plant_name STRING, event_type_name STRING, reminder_date TIMESTAMP_NTZ, message STRING, days_until INT",
        """SELECT r.id, p.name, y.name, r.reminder_date, r.message,
                  CAST(extract(DAY FROM r.reminder_date - upcoming_reminders.as_of) AS INT)
           FROM {p}reminders r JOIN {p}plants p ON r.plant_id = p.id JOIN {p}event_types y ON r.event_type_id = y.id
           WHERE r.is_sent = FALSE AND r.is_completed = FALSE AND r.reminder_date >= upcoming_reminders.as_of
             AND r.reminder_date <= upcoming_reminders.as_of + make_dt_interval(upcoming_reminders.days_ahead)""",
    ),
    "measurement_trend": (
        "plant_id BIGINT, days_back INT DEFAULT 30",
        "measurement_date TIMESTAMP_NTZ, height_cm DOUBLE, width_cm DOUBLE, leaf_count INT, health_status INT, notes STRING, days_ago INT",
        """SELECT m.measurement_date, m.height_cm, m.width_cm, m.leaf_count, m.health_status, m.notes,
                  CAST(extract(DAY FROM measurement_trend.as_of - m.measurement_date) AS INT)
           FROM {p}measurements m
           WHERE m.plant_id = measurement_trend.plant_id
             AND m.measurement_date >= measurement_trend.as_of - make_dt_interval(measurement_trend.days_back)""",
    ),
    "health_analysis": (
        "",
        "plant_id BIGINT, plant_name STRING, plant_type STRING, current_health_status INT, avg_health_status DOUBLE, "
        "health_trend STRING, last_measurement_date TIMESTAMP_NTZ, days_since_measurement INT, needs_attention BOOLEAN",
        "SELECT h.* FROM {p}health h",
    ),
}


def register_functions(
    spark: SparkSession, t: CareTables, as_of=None, history: DataFrame | None = None, prefix: str = "care_"
) -> list[str]:
    """The source's table functions as Spark SQL functions, for ``spark.sql``:

    ``SELECT * FROM upcoming_reminders(14)``,
    ``SELECT p.id, m.* FROM care_plants p, LATERAL measurement_trend(p.id, 20) m``.

    Each takes its own parameters and, last, ``as_of`` (a TIMESTAMP_NTZ), which defaults
    to the value given here or else to the time of the call; those that look up rows by
    their own arguments, or sums over a span before that time, have none.  They are temporary, as are the views
    ``<prefix>plants`` and so on that they read.  Spark inlines a function's query, so a
    call is one plan: filters reach the scans, a LATERAL call with a column as
    ``plant_id`` becomes an equi-join, a plant without rows gives none (LEFT JOIN
    LATERAL keeps it).  A NULL argument finds nothing.  ``history`` is by default
    what ``audit_rows`` gives for the change feed."""
    history = TM.audit_rows(t.plant_changes) if history is None else history
    state = ["id", "name", "plant_type_id", "location", "notes", "valid_from", "valid_to"]
    water = t.event_types.where(F.col("name") == A.WATER).select(F.col("id").alias("event_type_id"))
    last_water = (
        t.events.where(F.col("is_completed")).join(water, "event_type_id", "left_semi")
        .groupBy("plant_id").agg(F.max("event_date").alias("last_water"))
    )
    active = t.plants.where(F.col("is_active")).select(F.col("id").alias("plant_id"), F.col("name").alias("plant_name"), "created_at")
    newest = latest_per_key(
        t.measurements, "plant_id", ["health_status", "measurement_date"], "measurement_date",
        where=F.col("health_status").isNotNull(),
    )
    views = {
        "plants": t.plants,
        "plant_types": t.plant_types,
        "event_types": t.event_types,
        "events": t.events,
        "reminders": t.reminders,
        "measurements": t.measurements,
        "plant_history": history,
        "plant_states": t.plants.select(state).unionByName(history.select(state)),
        "growth": A.growth_stats(t),
        "health": A.health_analysis(t, as_of),
        "watering": active.join(last_water, "plant_id", "left"),
        "newest_health": active.join(newest, "plant_id"),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    now = "localtimestamp()" if as_of is None else f"TIMESTAMP_NTZ'{_literal(as_of)}'"
    for name, (parameters, columns, query) in _FUNCTIONS.items():
        timed = f"{name}.as_of" in query
        given = [x for x in (parameters, f"as_of TIMESTAMP_NTZ DEFAULT {now}" if timed else "") if x]
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(given)}) RETURNS TABLE ({columns}) "
            f"RETURN {query.format(p=prefix)}"
        )
    return list(_FUNCTIONS)


def _literal(as_of) -> str:
    """A timestamp as text; anything else is refused, as it becomes part of a statement."""
    at = as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(str(as_of))
    return at.strftime("%Y-%m-%d %H:%M:%S.%f")
