"""Registered queries: temporal (TMP-*, FN-2/3/20), writes (SNK-*), rules
(RULE-*) and data quality (DQ-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendril.plans import changes as C
from tendril.plans import quality as Q
from tendril.plans import rules as R
from tendril.plans import temporal as TM
from tendril.registry import CH, EV, MS, T, register
from tendril.sources.roles import CHANGES_AS_OF, EVENTS_AS_OF, MEASURE_AS_OF

END = "TIMESTAMP '9999-12-31 23:59:59'"
STATE = "name, plant_type_id, planted_date, location, notes, is_active, created_at, updated_at"

VERSIONS_SQL = f"""
SELECT id, {STATE}, changed_at AS valid_from, COALESCE(nxt, {END}) AS valid_to,
       operation_type, changed_by, changed_at, seq
FROM (SELECT *, lead(changed_at) OVER (PARTITION BY id ORDER BY changed_at, seq) AS nxt FROM plant_changes) c
WHERE operation_type <> 'DELETE'"""

AUDIT_SQL = (
    "SELECT id, "
    + ", ".join(f"CASE WHEN operation_type = 'INSERT' THEN {c} ELSE p_{c} END AS {c}" for c in TM.STATE_COLS)
    + f""",
       CASE WHEN operation_type = 'INSERT' THEN changed_at ELSE p_changed_at END AS valid_from,
       CASE WHEN operation_type = 'INSERT' THEN {END} ELSE changed_at END AS valid_to,
       operation_type, changed_by, changed_at, seq
FROM (SELECT *, """
    + ", ".join(f"lag({c}) OVER w AS p_{c}" for c in TM.STATE_COLS + ["changed_at"])
    + """ FROM plant_changes WINDOW w AS (PARTITION BY id ORDER BY changed_at, seq)) c"""
)

LAST_CHANGE_SQL = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY changed_at DESC, seq DESC) AS rn
               FROM plant_changes) x WHERE rn = 1"""


def _versions(spark, sf_dir):
    return TM.scd2_build(T(spark, sf_dir).plant_changes)


def _audit(spark, sf_dir):
    return TM.audit_rows(T(spark, sf_dir).plant_changes)


@register("scd2_versions", VERSIONS_SQL)
def q_scd2_versions(spark, sf_dir):
    return _versions(spark, sf_dir)


@register(
    "plant_at_time",
    f"""
WITH v AS ({VERSIONS_SQL})
SELECT id, name, plant_type_id, location, notes, valid_from, valid_to FROM v
WHERE valid_from <= {CH} AND valid_to > {CH}""",
)
def q_plant_at_time(spark, sf_dir):
    return TM.as_of_lookup(_versions(spark, sf_dir), CHANGES_AS_OF)


@register(
    "events_plant_location",
    f"""
WITH v AS ({VERSIONS_SQL})
SELECT e.id, e.plant_id, e.event_date, v.location AS at_location, v.name AS at_name
FROM care_events e LEFT JOIN v ON v.id = e.plant_id AND v.valid_from <= e.event_date AND v.valid_to > e.event_date""",
)
def q_events_plant_location(spark, sf_dir):
    t = T(spark, sf_dir)
    facts = t.events.select("id", "plant_id", "event_date")
    return TM.temporal_join(facts, _versions(spark, sf_dir), "plant_id", "event_date", ["location", "name"])


@register(
    "plant_at_time_union",
    f"""
WITH a AS ({AUDIT_SQL})
SELECT id, name, plant_type_id, location, notes FROM plants WHERE valid_from <= {CH} AND valid_to > {CH}
UNION ALL
SELECT id, name, plant_type_id, location, notes FROM a WHERE valid_from <= {CH} AND valid_to > {CH}""",
)
def q_plant_at_time_union(spark, sf_dir):
    return TM.point_in_time(T(spark, sf_dir).plants, _audit(spark, sf_dir), CHANGES_AS_OF)


@register("audit_rows", AUDIT_SQL)
def q_audit_rows(spark, sf_dir):
    return _audit(spark, sf_dir)


@register(
    "plant_history",
    f"""
WITH a AS ({AUDIT_SQL})
SELECT id, name, location, valid_from, valid_to, operation_type, changed_at, seq FROM a""",
)
def q_plant_history(spark, sf_dir):
    return TM.plant_history(_audit(spark, sf_dir))


@register(
    "plant_history_labeled",
    f"""
WITH a AS ({AUDIT_SQL})
SELECT id, name, location, valid_from, valid_to, operation_type, changed_at, seq,
       CASE operation_type WHEN 'INSERT' THEN 'CREATED' WHEN 'UPDATE' THEN 'UPDATED' WHEN 'DELETE' THEN 'DELETED'
            ELSE operation_type END AS operation_label,
       year(valid_to) < 9999 AS is_closed
FROM a""",
)
def q_plant_history_labeled(spark, sf_dir):
    return TM.history_labeled(_audit(spark, sf_dir))


@register(
    "history_summary",
    f"""
WITH a AS ({AUDIT_SQL})
SELECT id, count(*) AS n_changes, max(changed_at) AS last_change,
       count(*) FILTER (WHERE operation_type = 'INSERT') AS n_inserts,
       count(*) FILTER (WHERE operation_type = 'UPDATE') AS n_updates,
       count(*) FILTER (WHERE operation_type = 'DELETE') AS n_deletes,
       count(*) FILTER (WHERE year(valid_to) < 9999) AS n_closed
FROM a GROUP BY id""",
)
def q_history_summary(spark, sf_dir):
    return TM.history_summary(_audit(spark, sf_dir))


@register(
    "plants_after_changes",
    f"""
WITH last AS ({LAST_CHANGE_SQL})
SELECT p.* FROM plants p WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.id = p.id)
UNION ALL
SELECT id, name, plant_type_id, planted_date, location, notes, is_active, created_at,
       changed_at AS updated_at, changed_at AS valid_from, {END} AS valid_to
FROM last WHERE operation_type <> 'DELETE'""",
)
def q_plants_after_changes(spark, sf_dir):
    t = T(spark, sf_dir)
    return C.apply_changes(t.plants, t.plant_changes)


@register(
    "events_after_cascade",
    f"""
WITH last AS ({LAST_CHANGE_SQL}), del AS (SELECT id FROM last WHERE operation_type = 'DELETE')
SELECT e.* FROM care_events e WHERE NOT EXISTS (SELECT 1 FROM del d WHERE d.id = e.plant_id)""",
)
def q_events_after_cascade(spark, sf_dir):
    t = T(spark, sf_dir)
    return C.cascade_delete({"events": t.events}, C.deleted_keys(t.plant_changes))["events"]


@register(
    "events_after_completion",
    """
SELECT e.id, e.plant_id, e.event_type_id, e.event_date, e.description, e.notes, e.reminder_date,
       COALESCE(d.done, e.is_completed) AS is_completed, e.created_at, e.updated_at
FROM care_events e LEFT JOIN (SELECT DISTINCT id, TRUE AS done FROM reminders WHERE is_sent) d ON d.id = e.id""",
)
def q_events_after_completion(spark, sf_dir):
    t = T(spark, sf_dir)
    return C.complete(t.events, t.reminders.where(F.col("is_sent")).select("id"))


# ------------------------------------------------------------------ rules
def _event_requests(t):
    return t.events.select(
        F.col("id").alias("request_id"),
        "plant_id",
        "event_type_id",
        "event_date",
        "description",
        F.when(F.col("id") % 7 == 0, 0).when(F.col("id") % 7 == 1, 2).alias("custom_reminder_days"),
    )


def _measurement_requests(t):
    return t.measurements.select(
        F.col("id").alias("request_id"),
        "plant_id",
        "height_cm",
        "width_cm",
        "leaf_count",
        "flower_count",
        (F.col("leaf_count") % 7).alias("health_status"),
        "notes",
    )


def _event_forms(t):
    """Event forms as sent: some with the empty choice 0, some with a type that does not exist."""
    kind = F.when(F.col("id") % 11 == 0, 0).when(F.col("id") % 13 == 0, 9).otherwise(F.col("event_type_id"))
    return t.events.select(F.col("id").alias("request_id"), "plant_id", kind.alias("event_type_id"), "event_date")


def _plant_forms(t):
    """Plant forms as sent: some with a type that does not exist, some without one."""
    kind = F.when(F.col("id") % 23 == 0, 99).otherwise(F.col("plant_type_id"))
    return t.plants.select(
        F.col("id").alias("request_id"), "name", kind.alias("plant_type_id"), "planted_date", "location"
    )


REQ_E_FORM_SQL = """SELECT id AS request_id, plant_id, event_date,
       CASE WHEN id % 11 = 0 THEN 0 WHEN id % 13 = 0 THEN 9 ELSE event_type_id END AS event_type_id FROM care_events"""

REQ_P_SQL = """SELECT id AS request_id, name, planted_date, location,
       CASE WHEN id % 23 = 0 THEN 99 ELSE plant_type_id END AS plant_type_id FROM plants"""

REQ_M_SQL = """SELECT id AS request_id, plant_id, height_cm, width_cm, leaf_count, flower_count,
       leaf_count % 7 AS health_status, notes FROM measurements"""

RULE1_SQL = f"""
SELECT e.plant_id, e.event_type_id, e.event_date - to_days(et.default_reminder_days) AS reminder_date,
       'Reminder: ' || et.name || ' for plant ' || p.name AS message, false AS is_sent, false AS is_completed,
       {{now}} AS created_at, e.id AS source_event_id
FROM {{src}} e JOIN event_types et ON e.event_type_id = et.id LEFT JOIN plants p ON p.id = e.plant_id
WHERE et.default_reminder_days > 0"""

NEXT_SQL = f"""
SELECT e.id AS source_event_id, e.plant_id, e.event_type_id,
       {EV} + to_days(CASE WHEN et.name = 'WATER' THEN pt.watering_frequency_days
                           ELSE pt.fertilizing_frequency_days END) AS event_date,
       'Auto-created: ' || et.name AS description, false AS is_completed, {EV} AS created_at
FROM care_events e JOIN event_types et ON e.event_type_id = et.id JOIN plants p ON p.id = e.plant_id
JOIN plant_types pt ON pt.id = p.plant_type_id
WHERE e.is_completed = TRUE AND et.name IN ('WATER', 'FERTILIZE')"""


@register("event_reminders", RULE1_SQL.format(now=EV, src="care_events"))
def q_event_reminders(spark, sf_dir):
    t = T(spark, sf_dir)
    return R.event_reminders(t.events, t, EVENTS_AS_OF)


@register(
    "event_with_reminder",
    f"""
WITH req AS (SELECT id AS request_id, plant_id, event_type_id, event_date, description,
                    CASE id % 7 WHEN 0 THEN 0 WHEN 1 THEN 2 END AS custom_reminder_days FROM care_events)
SELECT r.plant_id, r.event_type_id,
       r.event_date - to_days(COALESCE(r.custom_reminder_days, et.default_reminder_days)) AS reminder_date,
       'Reminder: ' || et.name || ' for plant ' || p.name AS message, false AS is_sent, false AS is_completed,
       {EV} AS created_at, r.request_id AS source_event_id
FROM req r LEFT JOIN event_types et ON r.event_type_id = et.id LEFT JOIN plants p ON p.id = r.plant_id
WHERE COALESCE(r.custom_reminder_days, et.default_reminder_days) > 0""",
)
def q_event_with_reminder(spark, sf_dir):
    t = T(spark, sf_dir)
    return R.event_with_reminder(_event_requests(t), t, EVENTS_AS_OF)["reminders"]


@register(
    "event_with_reminder_and_trigger",
    f"""
WITH req AS (SELECT id AS request_id, plant_id, event_type_id, event_date, description,
                    CASE id % 7 WHEN 0 THEN 0 WHEN 1 THEN 2 END AS custom_reminder_days FROM care_events),
own AS (
  SELECT r.plant_id, r.event_type_id,
         r.event_date - to_days(COALESCE(r.custom_reminder_days, et.default_reminder_days)) AS reminder_date,
         'Reminder: ' || et.name || ' for plant ' || p.name AS message, false AS is_sent, false AS is_completed,
         {EV} AS created_at, r.request_id AS source_event_id
  FROM req r LEFT JOIN event_types et ON r.event_type_id = et.id LEFT JOIN plants p ON p.id = r.plant_id
  WHERE COALESCE(r.custom_reminder_days, et.default_reminder_days) > 0),
trig AS ({RULE1_SQL.format(now=EV, src="(SELECT request_id AS id, plant_id, event_type_id, event_date FROM req)")})
SELECT * FROM own UNION ALL SELECT * FROM trig""",
)
def q_event_with_reminder_and_trigger(spark, sf_dir):
    """RULE-2 as the source runs it: the event insert also fires RULE-1 (G10)."""
    t = T(spark, sf_dir)
    return R.event_with_reminder(_event_requests(t), t, EVENTS_AS_OF, with_rule_1=True)["reminders"]


def _old_new(t):
    return t.events.withColumn("is_completed", F.lit(False)), t.events


@register("next_events", NEXT_SQL)
def q_next_events(spark, sf_dir):
    t = T(spark, sf_dir)
    old, new = _old_new(t)
    return R.next_events(old, new, t, EVENTS_AS_OF)


@register(
    "next_event_reminders",
    "WITH nxt AS (SELECT source_event_id AS id, plant_id, event_type_id, event_date FROM (" + NEXT_SQL + ") x)\n"
    + RULE1_SQL.format(now=EV, src="nxt"),
)
def q_next_event_reminders(spark, sf_dir):
    t = T(spark, sf_dir)
    old, new = _old_new(t)
    return R.next_event_reminders(old, new, t, EVENTS_AS_OF)


HEALTH_WARN_SQL = f"""
SELECT m.plant_id, (SELECT id FROM event_types WHERE name = 'SPRAY') AS event_type_id,
       {{now}} + INTERVAL 1 DAY AS reminder_date,
       'Warning: Plant ' || p.name || ' is in poor health. Attention needed!' AS message,
       false AS is_sent, false AS is_completed, {{now}} AS created_at, m.id AS source_measurement_id
FROM {{src}} m LEFT JOIN plants p ON p.id = m.plant_id WHERE m.health_status <= 2"""


@register("health_warnings", HEALTH_WARN_SQL.format(now=MS, src="measurements"))
def q_health_warnings(spark, sf_dir):
    t = T(spark, sf_dir)
    return R.health_warnings(t.measurements, t, MEASURE_AS_OF)


ACCEPTED_SQL = f"""
SELECT r.*, {MS} AS measurement_date FROM ({REQ_M_SQL}) r JOIN plants p ON p.id = r.plant_id AND p.is_active
WHERE r.health_status IS NULL OR r.health_status BETWEEN 1 AND 5"""


@register(
    "record_measurements_events",
    f"""
WITH acc AS ({ACCEPTED_SQL})
SELECT request_id AS id, plant_id, (SELECT id FROM event_types WHERE name = 'MEASURE') AS event_type_id,
       {MS} AS event_date,
       'Auto measurement: ' || COALESCE('Height ' || printf('%.2f', height_cm) || 'cm', '')
         || COALESCE(', Leaves ' || CAST(leaf_count AS VARCHAR), '')
         || COALESCE(', Health ' || CAST(health_status AS VARCHAR) || '/5', '') AS description,
       true AS is_completed, {MS} AS created_at
FROM acc""",
)
def q_record_measurements_events(spark, sf_dir):
    t = T(spark, sf_dir)
    return R.record_measurements(_measurement_requests(t), t, MEASURE_AS_OF)["events"]


@register(
    "record_measurements_rejected",
    f"""
SELECT r.request_id, r.plant_id, r.health_status,
       CASE WHEN p.id IS NULL THEN 'plant does not exist or is not active'
            ELSE 'health status must be between 1 and 5' END AS reject_reason
FROM ({REQ_M_SQL}) r LEFT JOIN (SELECT id FROM plants WHERE is_active) p ON p.id = r.plant_id
WHERE p.id IS NULL OR (r.health_status IS NOT NULL AND (r.health_status < 1 OR r.health_status > 5))""",
)
def q_record_measurements_rejected(spark, sf_dir):
    t = T(spark, sf_dir)
    return R.record_measurements(_measurement_requests(t), t, MEASURE_AS_OF)["rejected"]


@register(
    "record_measurements_warnings",
    f"WITH acc AS (SELECT request_id AS id, plant_id, health_status FROM ({ACCEPTED_SQL}) a)\n"
    + HEALTH_WARN_SQL.format(now=MS, src="acc"),
)
def q_record_measurements_warnings(spark, sf_dir):
    t = T(spark, sf_dir)
    return R.record_measurements(_measurement_requests(t), t, MEASURE_AS_OF)["warnings"]


# ------------------------------------------------------------------ quality
def _v(table: str, rule: str, col: str, key: str, cond: str, src: str | None = None) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, '{col}' AS column_name, CAST({key} AS BIGINT) AS row_key "
        f"FROM {src or table} WHERE {cond}"
    )


def _range(table, col, lo, hi, key="id", src=None):
    return _v(table, "range", col, key, f"{col} IS NOT NULL AND NOT ({col} BETWEEN {lo} AND {hi})", src)


def _len(table, col, lo, hi):
    return _v(table, "length", col, "id", f"{col} IS NOT NULL AND (length({col}) < {lo} OR length({col}) > {hi})")


def _fk(table, col, parent):
    return _v(
        table, "foreign_key", col, "id", f"{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} q WHERE q.id = {table}.{col})"
    )


def _uniq(table, col):
    return _v(table, "unique", col, "id", f"{col} IN (SELECT {col} FROM {table} WHERE {col} IS NOT NULL GROUP BY {col} HAVING count(*) > 1)")


def _m_rules(table, key, src=None):
    parts = [_v(table, "not_null", "plant_id", key, "plant_id IS NULL", src)]
    for c, (lo, hi) in Q.MEASUREMENT_RULES_SPEC.items():
        parts.append(_range(table, c, lo, hi, key, src))
    return parts


def _choice(table, col, allowed, src):
    return _v(table, "choice", col, "request_id", f"{col} IS NOT NULL AND {col} NOT IN {allowed}", src)


DQ_SQL = "\nUNION ALL\n".join(
    [
        _v("plants", "not_null", "name", "id", "name IS NULL OR trim(name) = ''"),
        _v("plants", "not_null", "planted_date", "id", "planted_date IS NULL"),
        _len("plants", "name", 1, 100),
        _len("plants", "location", 0, 100),
        _uniq("plant_types", "name"),
        _v("plant_types", "not_null", "name", "id", "name IS NULL"),
        _len("plant_types", "scientific_name", 0, 150),
        _range("plant_types", "watering_frequency_days", 1, 365),
        _range("plant_types", "fertilizing_frequency_days", 1, 365),
        _uniq("event_types", "name"),
        _v("care_events", "not_null", "event_date", "id", "event_date IS NULL").replace("'care_events'", "'events'"),
        _fk("care_events", "plant_id", "plants").replace("'care_events'", "'events'"),
        _fk("care_events", "event_type_id", "event_types").replace("'care_events'", "'events'"),
        _v("reminders", "not_null", "reminder_date", "id", "reminder_date IS NULL"),
        _v("reminders", "not_null", "message", "id", "message IS NULL"),
        _fk("reminders", "plant_id", "plants"),
        *_m_rules("measurements", "id"),
        _fk("measurements", "plant_id", "plants"),
        _v("plant_images", "not_null", "filename", "id", "filename IS NULL"),
        _v(
            "plant_images",
            "extension",
            "original_filename",
            "id",
            "original_filename IS NOT NULL AND (instr(original_filename, '.') = 0 OR "
            "lower(split_part(original_filename, '.', -1)) NOT IN ('png', 'jpg', 'jpeg', 'gif'))",
        ),
        _fk("plant_images", "plant_id", "plants"),
        *_m_rules("measurement_requests", "request_id", f"({REQ_M_SQL}) mr"),
        _v(
            "measurement_requests",
            "choice",
            "plant_id",
            "request_id",
            "plant_id IS NOT NULL AND plant_id NOT IN (SELECT id FROM plants WHERE is_active)",
            f"({REQ_M_SQL}) mr",
        ),
        *[
            _v("event_requests", "not_null", c, "request_id", f"{c} IS NULL", f"({REQ_E_FORM_SQL}) er")
            for c in ("plant_id", "event_type_id", "event_date")
        ],
        _choice("event_requests", "plant_id", "(SELECT id FROM plants WHERE is_active)", f"({REQ_E_FORM_SQL}) er"),
        _choice("event_requests", "event_type_id", "(SELECT id FROM event_types)", f"({REQ_E_FORM_SQL}) er"),
        _v("plant_requests", "not_null", "name", "request_id", "name IS NULL OR trim(name) = ''", f"({REQ_P_SQL}) pr"),
        _v("plant_requests", "not_null", "planted_date", "request_id", "planted_date IS NULL", f"({REQ_P_SQL}) pr"),
        _v("plant_requests", "not_null", "plant_type_id", "request_id", "plant_type_id IS NULL", f"({REQ_P_SQL}) pr"),
        _v("plant_requests", "length", "name", "request_id", "length(name) < 1 OR length(name) > 100", f"({REQ_P_SQL}) pr"),
        _v("plant_requests", "length", "location", "request_id", "length(location) > 100", f"({REQ_P_SQL}) pr"),
        _choice("plant_requests", "plant_type_id", "(SELECT id FROM plant_types)", f"({REQ_P_SQL}) pr"),
    ]
)


def _violations(spark, sf_dir):
    t = T(spark, sf_dir)
    return Q.care_table_violations(t, _measurement_requests(t), _event_forms(t), _plant_forms(t))


@register("dq_violations", DQ_SQL)
def q_dq_violations(spark, sf_dir):
    return _violations(spark, sf_dir)


@register(
    "dq_summary",
    f"WITH v AS ({DQ_SQL})\nSELECT table_name, rule, column_name, count(*) AS violations FROM v GROUP BY ALL",
)
def q_dq_summary(spark, sf_dir):
    return Q.violation_summary(_violations(spark, sf_dir))


@register(
    "measurement_requests_quarantine",
    f"""
WITH mr AS ({REQ_M_SQL})
SELECT request_id, plant_id, health_status,
       list_filter([CASE WHEN plant_id IS NULL THEN 'not_null:plant_id' END,
                    CASE WHEN health_status IS NOT NULL AND NOT (health_status BETWEEN 1 AND 5)
                         THEN 'range:health_status' END,
                    CASE WHEN height_cm IS NOT NULL AND NOT (height_cm BETWEEN 0 AND 999.99)
                         THEN 'range:height_cm' END,
                    CASE WHEN width_cm IS NOT NULL AND NOT (width_cm BETWEEN 0 AND 999.99)
                         THEN 'range:width_cm' END,
                    CASE WHEN leaf_count IS NOT NULL AND NOT (leaf_count BETWEEN 0 AND 9999)
                         THEN 'range:leaf_count' END,
                    CASE WHEN flower_count IS NOT NULL AND NOT (flower_count BETWEEN 0 AND 9999)
                         THEN 'range:flower_count' END], lambda x: x IS NOT NULL) AS reasons
FROM mr
WHERE plant_id IS NULL OR (health_status IS NOT NULL AND NOT (health_status BETWEEN 1 AND 5))
   OR (height_cm IS NOT NULL AND NOT (height_cm BETWEEN 0 AND 999.99))
   OR (width_cm IS NOT NULL AND NOT (width_cm BETWEEN 0 AND 999.99))
   OR (leaf_count IS NOT NULL AND NOT (leaf_count BETWEEN 0 AND 9999))
   OR (flower_count IS NOT NULL AND NOT (flower_count BETWEEN 0 AND 9999))""",
)
def q_measurement_requests_quarantine(spark, sf_dir):
    t = T(spark, sf_dir)
    _, bad = Q.quarantine(_measurement_requests(t), Q.measurement_rules())
    return bad.select("request_id", "plant_id", "health_status", "reasons")
