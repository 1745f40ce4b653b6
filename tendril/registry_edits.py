"""Registered queries: edits of any table, rows with ids, list footers, key lookups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tendril.functions.days import parse_form_datetime
from tendril.operators import paging
from tendril.plans import analytics as A
from tendril.plans import changes as C
from tendril.plans import rules as R
from tendril.plans import temporal as TM
from tendril.registry import CH, EV, MS, T, register
from tendril.registry_temporal import (
    ACCEPTED_SQL,
    AUDIT_SQL,
    LAST_CHANGE_SQL,
    RULE1_SQL,
    _audit,
    _event_requests,
    _measurement_requests,
)
from tendril.sources.roles import CHANGES_AS_OF, EVENTS_AS_OF, MEASURE_AS_OF

# ------------------------------------------------ edit and delete of any table
NEW_IDS = 100_000_000  # ids of rows that a change batch inserts start here


def _change_batch(table, text_col: str, as_of: str):
    """Edits of every third row, deletions of every tenth, copies of every
    fiftieth row under a new id; a row may be edited and then deleted."""
    at = F.lit(as_of).cast("timestamp_ntz")
    edit = table.where(F.col("id") % 3 == 0).select(
        "id", "plant_id", F.concat(F.lit("edited "), F.col("id").cast("string")).alias(text_col),
        F.lit("UPDATE").alias("operation_type"), at.alias("changed_at"), F.lit(1).cast("long").alias("seq"),
    )
    gone = table.where(F.col("id") % 10 == 0).select(
        "id", "plant_id", F.lit(None).cast("string").alias(text_col),
        F.lit("DELETE").alias("operation_type"), at.alias("changed_at"), F.lit(2).cast("long").alias("seq"),
    )
    new = table.where(F.col("id") % 50 == 0).select(
        (F.col("id") + NEW_IDS).alias("id"), "plant_id", F.lit("new").alias(text_col),
        F.lit("INSERT").alias("operation_type"), at.alias("changed_at"), F.lit(3).cast("long").alias("seq"),
    )
    return edit.unionByName(gone).unionByName(new)


@register(
    "events_after_changes",
    f"""
SELECT id, plant_id, event_type_id, event_date, IF(id % 3 = 0, 'edited ' || id, description) AS description, notes,
       reminder_date, is_completed, created_at, IF(id % 3 = 0, {EV}, updated_at) AS updated_at
FROM care_events WHERE id % 10 <> 0
UNION ALL
SELECT id + {NEW_IDS}, plant_id, NULL, NULL, 'new', NULL, NULL, NULL, {EV}, {EV} FROM care_events WHERE id % 50 = 0""",
)
def q_events_after_changes(spark, sf_dir):
    t = T(spark, sf_dir)
    return C.apply_table_changes(t.events, _change_batch(t.events, "description", EVENTS_AS_OF))


@register(
    "measurements_after_changes",
    f"""
SELECT id, plant_id, measurement_date, height_cm, width_cm, leaf_count, flower_count, health_status,
       IF(id % 3 = 0, 'edited ' || id, notes) AS notes
FROM measurements WHERE id % 10 <> 0
UNION ALL
SELECT id + {NEW_IDS}, plant_id, NULL, NULL, NULL, NULL, NULL, NULL, 'new' FROM measurements WHERE id % 50 = 0""",
)
def q_measurements_after_changes(spark, sf_dir):
    t = T(spark, sf_dir)
    return C.apply_table_changes(t.measurements, _change_batch(t.measurements, "notes", MEASURE_AS_OF))


def _cascade(name: str):
    def run(spark, sf_dir):
        t = T(spark, sf_dir)
        return C.cascade_delete({name: getattr(t, name)}, C.deleted_keys(t.plant_changes))[name]

    return run


for _name, _alias in (("reminders", "reminders"), ("measurements", "measurements"), ("images", "plant_images")):
    register(
        f"{_name}_after_cascade",
        f"""
WITH gone AS (SELECT id AS plant_id FROM ({LAST_CHANGE_SQL}) WHERE operation_type = 'DELETE')
FROM {_alias} ANTI JOIN gone USING (plant_id)""",
    )(_cascade(_alias))


# ------------------------------------------------------- produced rows with ids
@register(
    "reminders_with_new_rows",
    f"""
WITH top AS (SELECT max(id) AS id FROM reminders),
made AS (SELECT * FROM ({RULE1_SQL.format(now=EV, src="care_events")}))
FROM reminders
UNION ALL BY NAME
SELECT top.id + source_event_id + 1 AS id, plant_id, event_type_id, reminder_date, message, is_sent, is_completed,
       created_at FROM made, top""",
)
def q_reminders_with_new_rows(spark, sf_dir):
    t = T(spark, sf_dir)
    made = R.event_reminders(t.events, t, EVENTS_AS_OF)
    return t.reminders.unionByName(R.table_rows(made, t.reminders, "source_event_id"))


@register(
    "request_events",
    f"""
SELECT id, plant_id, event_type_id, event_date, description, CAST(NULL AS VARCHAR) AS notes,
       CAST(NULL AS TIMESTAMP) AS reminder_date, false AS is_completed, {EV} AS created_at, {EV} AS updated_at
FROM care_events""",
)
def q_request_events(spark, sf_dir):
    t = T(spark, sf_dir)
    return R.event_with_reminder(_event_requests(t), t, EVENTS_AS_OF)["events"]


@register(
    "record_measurements_rows",
    f"SELECT request_id AS id, * EXCLUDE (request_id) FROM ({ACCEPTED_SQL}) a",
)
def q_record_measurements_rows(spark, sf_dir):
    t = T(spark, sf_dir)
    return R.record_measurements(_measurement_requests(t), t, MEASURE_AS_OF)["measurements"]


@register(
    "record_measurements_reminders",
    f"""
WITH made AS (SELECT request_id AS id, plant_id, {MS} AS event_date, k.id AS event_type_id
              FROM ({ACCEPTED_SQL}) a, event_types k WHERE k.name = 'WATER')"""
    + RULE1_SQL.format(now=MS, src="made"),
)
def q_record_measurements_reminders(spark, sf_dir):
    """RULE-1 on the events of RULE-5, with an event type that has reminder days."""
    t = T(spark, sf_dir)
    requests = _measurement_requests(t)
    return R.record_measurements(requests, t, MEASURE_AS_OF, measure="WATER", with_rule_1=True)["reminders"]


# ---------------------------------------------------------------- single sinks
@register(
    "plants_appended",
    f"""
SELECT * REPLACE (ifnull(is_active, TRUE) AS is_active, ifnull(valid_to, TIMESTAMP '9999-12-31 23:59:59') AS valid_to,
                  ifnull(created_at, {CH}) AS created_at, ifnull(updated_at, {CH}) AS updated_at,
                  ifnull(valid_from, {CH}) AS valid_from)
FROM (SELECT * REPLACE (IF(id % 2 = 0, NULL, is_active) AS is_active, IF(id % 3 = 0, NULL, valid_to) AS valid_to,
                        IF(id % 4 = 0, NULL, created_at) AS created_at, IF(id % 5 = 0, NULL, updated_at) AS updated_at,
                        NULL::TIMESTAMP AS valid_from) FROM plants)""",
)
def q_plants_appended(spark, sf_dir):
    """SNK-1 over a batch with missing values in every defaulted column."""
    plants = T(spark, sf_dir).plants
    blank = {"is_active": 2, "valid_to": 3, "created_at": 4, "updated_at": 5, "valid_from": 1}
    batch = plants.withColumns({c: F.when(F.col("id") % n != 0, F.col(c)) for c, n in blank.items()})
    return C.append_rows(batch, "plants", CHANGES_AS_OF)


@register("events_touched", f"SELECT * REPLACE ({EV} AS updated_at) FROM care_events")
def q_events_touched(spark, sf_dir):
    return C.touch_updated_at(T(spark, sf_dir).events, EVENTS_AS_OF)


@register(
    "choices_normalised",
    "SELECT id, nullif(plant_type_id % 3, 0) AS plant_type_id, nullif(id % 2, 0) AS choice FROM plants",
)
def q_choices_normalised(spark, sf_dir):
    """SNK-6: a choice of 0 means none."""
    p = T(spark, sf_dir).plants.select("id", (F.col("plant_type_id") % 3).alias("plant_type_id"), (F.col("id") % 2).alias("choice"))
    return C.normalise_missing(p, ["plant_type_id", "choice"])


@register(
    "form_dates_parsed",
    """
SELECT id, IF(id % 7 = 0, NULL, date_trunc('minute', event_date)) AS parsed FROM care_events""",
)
def q_form_dates_parsed(spark, sf_dir):
    """D-7 over the events' dates as form text; every seventh is not a date."""
    e = T(spark, sf_dir).events
    text = F.when(F.col("id") % 7 == 0, F.lit("31.12.2000 noon")).otherwise(F.date_format("event_date", "yyyy-MM-dd HH:mm"))
    return e.select("id", parse_form_datetime(text).alias("parsed"))


# --------------------------------------------------------- lookups and filters
@register(
    "plants_looked_up",
    """
WITH keys AS (SELECT DISTINCT 2 * plant_id AS id FROM care_events)
SELECT id, p.name, p.id IS NOT NULL AS found FROM keys LEFT JOIN plants p USING (id)""",
)
def q_plants_looked_up(spark, sf_dir):
    """F-4: rows of the requested keys and the keys that do not exist."""
    t = T(spark, sf_dir)
    keys = t.events.select((F.col("plant_id") * 2).alias("id")).distinct()
    found, missing = paging.lookup_keys(t.plants, keys)
    return found.select("id", "name", F.lit(True).alias("found")).unionByName(
        missing.select("id", F.lit(None).cast("string").alias("name"), F.lit(False).alias("found"))
    )


@register(
    "events_of_a_plant",
    """
SELECT e.id, e.plant_id, p.name AS plant_name, e.event_date FROM care_events e JOIN plants p ON p.id = e.plant_id
WHERE p.is_active AND e.plant_id = 7 ORDER BY e.event_date DESC, e.id DESC LIMIT 20""",
)
def q_events_of_a_plant(spark, sf_dir):
    """F-2: the plant filter of the event list."""
    return A.event_list(T(spark, sf_dir), EVENTS_AS_OF, 1, plant_id=7).select("id", "plant_id", "plant_name", "event_date")


@register(
    "plant_cards_of_a_type",
    """
SELECT id, name, plant_type_id FROM plants WHERE is_active AND plant_type_id = 3
ORDER BY created_at DESC NULLS FIRST, id DESC LIMIT 12""",
)
def q_plant_cards_of_a_type(spark, sf_dir):
    """F-2: the plant type filter of the cards."""
    return A.plant_cards(T(spark, sf_dir), 1, plant_type_id=3, as_of=MEASURE_AS_OF).select("id", "name", "plant_type_id")


@register(
    "plant_history_of",
    f"""
SELECT id, name, location, valid_from, valid_to, operation_type, changed_at, seq FROM ({AUDIT_SQL}) a
WHERE id IN (SELECT plant_id FROM measurements)""",
)
def q_plant_history_of(spark, sf_dir):
    """FN-2 for the plants that have measurements."""
    ids = T(spark, sf_dir).measurements.select(F.col("plant_id").alias("id")).distinct()
    return TM.plant_history(_audit(spark, sf_dir), ids)


# ----------------------------------------------------------------- seek pages
SEEK_AFTER = (dt.datetime(2024, 1, 20), 40)


@register(
    "measurement_seek_page",
    """
SELECT m.id, m.plant_id, m.measurement_date FROM measurements m
WHERE (measurement_date, id) < (TIMESTAMP '2024-01-20 00:00:00', 40)
ORDER BY measurement_date DESC NULLS FIRST, id DESC LIMIT 20""",
)
def q_measurement_seek_page(spark, sf_dir):
    """T-3 as a seek page: the 20 measurements after a given one, newest first."""
    m = T(spark, sf_dir).measurements.select("id", "plant_id", "measurement_date")
    return paging.page_after(m, ["measurement_date", "id"], SEEK_AFTER, 20)


# ----------------------------------------------------------------- page totals
def _totals_sql(rows: str, page: int, size: int) -> str:
    return f"""
WITH n AS (SELECT count(*) AS total FROM ({rows}))
SELECT {page} AS page, CAST(ceil(total / {size}) AS INTEGER) AS pages, total, {str(page > 1).lower()} AS has_prev,
       {page} < ceil(total / {size}) AS has_next FROM n"""


_LISTS = {
    "plant": ("plants", 2, A.PLANTS_PAGE),
    "event": ("care_events", 1, A.EVENTS_PAGE),
    "measurement": ("measurements", 3, A.MEASUREMENTS_PAGE),
    "image": ("plant_images", 1, A.IMAGES_PAGE),
}


def _totals(name: str, page: int, size: int):
    def run(spark, sf_dir):
        t = T(spark, sf_dir)
        child = {"event": t.events, "measurement": t.measurements, "image": t.plant_images}.get(name)
        rows = t.plants.where("is_active") if child is None else C.active_children(child, t.plants)
        return paging.page_totals(rows, page, size)

    return run


for _name, (_table, _page, _size) in _LISTS.items():
    _rows = (
        "FROM plants WHERE is_active"
        if _name == "plant"
        else f"FROM {_table} WHERE plant_id IN (SELECT id FROM plants WHERE is_active)"
    )
    register(f"{_name}_page_totals", _totals_sql(_rows, _page, _size))(_totals(_name, _page, _size))

