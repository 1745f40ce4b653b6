"""Registered queries: SQL table functions, overlapping histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendril.operators.intervals import stabbing_join
from tendril.plans import temporal as TM
from tendril.plans.sql import register_functions
from tendril.registry import CH, MS, T, register, wd
from tendril.registry_temporal import AUDIT_SQL
from tendril.sources.roles import EVENTS_AS_OF, MEASURE_AS_OF


@register(
    "sql_upcoming_reminders",
    f"""
WITH days(n) AS (VALUES (7), (1200))
SELECT n AS days_ahead, r.id AS reminder_id, p.name AS plant_name, y.name AS event_type_name, reminder_date, message,
       {wd("reminder_date", CH)} AS days_until
FROM days, reminders r JOIN plants p ON r.plant_id = p.id JOIN event_types y ON r.event_type_id = y.id
WHERE NOT is_sent AND NOT r.is_completed AND reminder_date BETWEEN {CH} AND {CH} + to_days(n)""",
)
def q_sql_upcoming_reminders(spark, sf_dir):
    register_functions(spark, T(spark, sf_dir), "1998-01-01 00:00:00")
    return spark.sql(
        "SELECT 7 AS days_ahead, * FROM upcoming_reminders() UNION ALL SELECT 1200, * FROM upcoming_reminders(1200)"
    )


@register(
    "sql_measurement_trends",
    f"""
SELECT p.id AS plant_id, measurement_date, height_cm, width_cm, leaf_count, health_status, m.notes,
       {wd(MS, "measurement_date")} AS days_ago
FROM plants p JOIN measurements m ON m.plant_id = p.id
WHERE p.is_active AND measurement_date >= {MS} - INTERVAL 20 DAY""",
)
def q_sql_measurement_trends(spark, sf_dir):
    register_functions(spark, T(spark, sf_dir), MEASURE_AS_OF)
    return spark.sql(
        "SELECT p.id AS plant_id, m.* FROM care_plants p, LATERAL measurement_trend(p.id, days_back => 20) m WHERE p.is_active"
    )


@register(
    "sql_plants_at_events",
    f"""
WITH a AS ({AUDIT_SQL}),
states AS (SELECT id, location, valid_from, valid_to FROM plants UNION ALL SELECT id, location, valid_from, valid_to FROM a)
SELECT e.id AS event_id, s.location AS location, count(*) AS n
FROM care_events e LEFT JOIN states s ON s.id = e.plant_id AND valid_from <= event_date AND valid_to > event_date
GROUP BY ALL""",
)
def q_sql_plants_at_events(spark, sf_dir):
    register_functions(spark, T(spark, sf_dir), EVENTS_AS_OF)
    return spark.sql(
        "SELECT e.id AS event_id, s.location, count(*) AS n "
        "FROM care_events e LEFT JOIN LATERAL plant_at_time(e.plant_id, e.event_date) s ON true GROUP BY ALL"
    )


@register(
    "sql_health_by_type",
    f"""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY measurement_date IS NULL DESC, measurement_date DESC, id DESC) AS rn
           FROM measurements),
x AS (SELECT plant_id, sum(health_status) FILTER (WHERE measurement_date >= {MS} - INTERVAL 90 DAY) AS s,
             count(health_status) FILTER (WHERE measurement_date >= {MS} - INTERVAL 90 DAY) AS n,
             max(health_status) FILTER (WHERE rn = 1) AS health, max(measurement_date) FILTER (WHERE rn = 1) AS last_date
      FROM m GROUP BY plant_id)
SELECT y.name AS plant_type, count(*) AS plants, count(*) FILTER (WHERE health * n > s) AS improving,
       count(*) FILTER (WHERE health * n < s) AS worsening,
       count(*) FILTER (WHERE health <= 2 OR {wd(MS, "last_date")} > 30) AS attention
FROM plants p LEFT JOIN plant_types y ON p.plant_type_id = y.id LEFT JOIN x ON x.plant_id = p.id
WHERE p.is_active GROUP BY y.name""",
)
def q_sql_health_by_type(spark, sf_dir):
    register_functions(spark, T(spark, sf_dir), MEASURE_AS_OF)
    return spark.sql(
        "SELECT plant_type, count(*) AS plants, count_if(health_trend = 'IMPROVING') AS improving, "
        "count_if(health_trend = 'WORSENING') AS worsening, count_if(needs_attention) AS attention "
        "FROM health_analysis() GROUP BY plant_type"
    )


@register(
    "events_valid_history",
    f"""
WITH a AS ({AUDIT_SQL})
SELECT e.id, e.plant_id, e.event_date, a.location AS v_location, a.operation_type AS v_operation_type, a.seq AS v_seq,
       a.valid_from AS v_valid_from, a.valid_to AS v_valid_to
FROM care_events e JOIN a ON a.id = e.plant_id AND a.valid_from <= e.event_date AND a.valid_to > e.event_date""",
)
def q_events_valid_history(spark, sf_dir):
    t = T(spark, sf_dir)
    facts = t.events.select("id", "plant_id", "event_date")
    a = TM.audit_rows(t.plant_changes).select(
        F.col("id").alias("plant_id"), "valid_from", "valid_to", "location", "operation_type", "seq"
    )
    return stabbing_join(facts, a, "plant_id", "event_date")
