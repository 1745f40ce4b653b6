"""Event rules (RULE-1 .. RULE-5): the source's triggers and mutating
functions as batch jobs - rows in, derived rows out.

Each rule is a join to bounded type catalogs (broadcast after a size check)
and to plants (planner's choice), then projections.  Type ids looked up by
name use a scalar sub-query (one value, checked unique by Spark at run time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.functions.days import add_days, as_ts
from tendril.plans.analytics import FERTILIZE, MEASURE, SPRAY, WATER
from tendril.sources.tables import CareTables

# Message parts (English codes of the source's texts).
REMINDER_PREFIX = "Reminder: "
FOR_PLANT = " for plant "
AUTO_PREFIX = "Auto-created: "
WARNING_PREFIX = "Warning: Plant "
WARNING_SUFFIX = " is in poor health. Attention needed!"
AUTO_MEASURE = "Auto measurement: "
REJECT_PLANT = "plant does not exist or is not active"
REJECT_HEALTH = "health status must be between 1 and 5"


def _type_id(t: CareTables, name: str) -> Column:
    return t.event_types.where(F.col("name") == name).select("id").scalar()


def _names(t: CareTables) -> DataFrame:
    return t.plants.select(F.col("id").alias("_pid"), F.col("name").alias("_pname"))


def _reminder_message(type_name: Column, plant_name: Column) -> Column:
    # NULL-propagating concat: an unknown plant gives a NULL message (quarantined by DQ).
    return F.concat(F.lit(REMINDER_PREFIX), type_name, F.lit(FOR_PLANT), plant_name)


def _reminder_shape(df: DataFrame, as_of, source: str) -> DataFrame:
    return df.select(
        "plant_id",
        "event_type_id",
        "reminder_date",
        "message",
        F.lit(False).alias("is_sent"),
        F.lit(False).alias("is_completed"),
        as_ts(as_of).alias("created_at"),
        F.col(source).alias(source),
    )


# ------------------------------------------------------------------- RULE-1
def event_reminders(events: DataFrame, t: CareTables, as_of) -> DataFrame:
    """Per new event whose type has default days > 0: a reminder that many
    days before the event.  Unknown type -> no reminder."""
    types = t.dim("event_types").select(
        F.col("id").alias("event_type_id"), F.col("name").alias("_tname"), F.col("default_reminder_days").alias("_d")
    )
    e = events.join(types, "event_type_id").where(F.col("_d") > 0)
    e = e.join(_names(t), F.col("plant_id") == F.col("_pid"), "left")
    e = e.select(
        "plant_id",
        "event_type_id",
        add_days(F.col("event_date"), -F.col("_d")).alias("reminder_date"),
        _reminder_message(F.col("_tname"), F.col("_pname")).alias("message"),
        F.col("id").alias("source_event_id"),
    )
    return _reminder_shape(e, as_of, "source_event_id")


# ------------------------------------------------------------------- RULE-2
def event_with_reminder(requests: DataFrame, t: CareTables, as_of, with_rule_1: bool = False) -> dict[str, DataFrame]:
    """Requests (request_id, plant_id, event_type_id, event_date, description,
    custom_reminder_days) -> new events and their reminders; custom days
    override the type's default, 0 or less means none.  In the source the
    event insert also fires RULE-1, giving a second reminder; that copy is
    added only with ``with_rule_1=True``."""
    now = as_ts(as_of)
    events = requests.select(
        F.col("request_id").alias("id"),
        "plant_id",
        "event_type_id",
        "event_date",
        "description",
        F.lit(None).cast("string").alias("notes"),
        F.lit(None).cast("timestamp_ntz").alias("reminder_date"),
        F.lit(False).alias("is_completed"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    types = t.dim("event_types").select(
        F.col("id").alias("_tid"), F.col("name").alias("_tname"), F.col("default_reminder_days").alias("_d")
    )
    r = requests.join(types, F.col("event_type_id") == F.col("_tid"), "left")
    r = r.withColumn("_days", F.coalesce(F.col("custom_reminder_days"), F.col("_d"))).where(F.col("_days") > 0)
    r = r.join(_names(t), F.col("plant_id") == F.col("_pid"), "left").select(
        "plant_id",
        "event_type_id",
        add_days(F.col("event_date"), -F.col("_days")).alias("reminder_date"),
        _reminder_message(F.col("_tname"), F.col("_pname")).alias("message"),
        F.col("request_id").alias("source_event_id"),
    )
    reminders = _reminder_shape(r, as_of, "source_event_id")
    if with_rule_1:
        reminders = reminders.unionByName(event_reminders(events, t, as_of))
    return {"events": events, "reminders": reminders}


# ------------------------------------------------------------------- RULE-3
def completion_transitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events whose completion went from FALSE (exactly) to TRUE."""
    before = old.select(F.col("id").alias("_oid"), F.col("is_completed").alias("_was"))
    j = new.join(before, F.col("id") == F.col("_oid"))
    return j.where((F.col("_was") == False) & (F.col("is_completed") == True)).drop("_oid", "_was")  # noqa: E712


def next_events(
    old: DataFrame, new: DataFrame, t: CareTables, as_of, water: str = WATER, fertilize: str = FERTILIZE
) -> DataFrame:
    """On completion of a watering / fertilizing event: the next one at
    ``as_of`` + the plant type's interval.  Other types, or plants without a
    type, get none."""
    done = completion_transitions(old, new)
    types = t.dim("event_types").select(F.col("id").alias("event_type_id"), F.col("name").alias("_tname"))
    freq = t.plants.select(F.col("id").alias("plant_id"), "plant_type_id").join(
        t.dim("plant_types").select(
            F.col("id").alias("plant_type_id"),
            F.col("watering_frequency_days").alias("_w"),
            F.col("fertilizing_frequency_days").alias("_f"),
        ),
        "plant_type_id",
    )
    d = done.join(types, "event_type_id").join(freq, "plant_id")
    days = F.when(F.col("_tname") == water, F.col("_w")).when(F.col("_tname") == fertilize, F.col("_f"))
    d = d.withColumn("_days", days).where(F.col("_days").isNotNull())
    now = as_ts(as_of)
    return d.select(
        F.col("id").alias("source_event_id"),
        "plant_id",
        "event_type_id",
        add_days(now, F.col("_days")).alias("event_date"),
        F.concat(F.lit(AUTO_PREFIX), F.col("_tname")).alias("description"),
        F.lit(False).alias("is_completed"),
        now.alias("created_at"),
    )


def next_event_reminders(old: DataFrame, new: DataFrame, t: CareTables, as_of) -> DataFrame:
    """RULE-3 then RULE-1 on its output (the insert fires the reminder rule)."""
    nxt = next_events(old, new, t, as_of).withColumnRenamed("source_event_id", "id")
    return event_reminders(nxt, t, as_of)


# ------------------------------------------------------------------- RULE-4
def health_warnings(measurements: DataFrame, t: CareTables, as_of, spray: str = SPRAY) -> DataFrame:
    """Per new measurement with health <= 2: a reminder of the spraying type
    one day after ``as_of`` with a warning naming the plant."""
    now = as_ts(as_of)
    m = measurements.where(F.col("health_status") <= 2)
    m = m.join(_names(t), F.col("plant_id") == F.col("_pid"), "left")
    return m.select(
        "plant_id",
        _type_id(t, spray).alias("event_type_id"),
        add_days(now, 1).alias("reminder_date"),
        F.concat(F.lit(WARNING_PREFIX), F.col("_pname"), F.lit(WARNING_SUFFIX)).alias("message"),
        F.lit(False).alias("is_sent"),
        F.lit(False).alias("is_completed"),
        now.alias("created_at"),
        F.col("id").alias("source_measurement_id"),
    )


# ------------------------------------------------------------------- RULE-5
def record_measurements(
    requests: DataFrame, t: CareTables, as_of, measure: str = MEASURE, with_rule_1: bool = False
) -> dict[str, DataFrame]:
    """Requests (request_id, plant_id, height_cm, width_cm, leaf_count,
    flower_count, health_status, notes) -> accepted measurements, their
    completed "measuring" events, RULE-4 warnings, and rejected requests with
    the first failing reason (plant missing / inactive, then health range).
    In the source the event insert also fires RULE-1; its reminders are added
    as ``reminders`` with ``with_rule_1=True``."""
    now = as_ts(as_of)
    from tendril.plans.quality import with_match_flag

    # J-7: EXISTS gate on active plants (a left join to their primary key)
    r = with_match_flag(requests, "plant_id", t.plants.where(F.col("is_active")), "id", "_active", unique=True)
    h = F.col("health_status")
    reason = F.when(~F.col("_active"), F.lit(REJECT_PLANT)).when(
        h.isNotNull() & ((h < 1) | (h > 5)), F.lit(REJECT_HEALTH)
    )
    r = r.withColumn("reject_reason", reason).drop("_active")
    accepted = r.where(F.col("reject_reason").isNull())
    measurements = accepted.select(
        F.col("request_id").alias("id"),
        "plant_id",
        now.alias("measurement_date"),
        "height_cm",
        "width_cm",
        "leaf_count",
        "flower_count",
        "health_status",
        "notes",
    )
    text = F.concat(
        F.lit(AUTO_MEASURE),
        F.coalesce(
            F.when(
                F.col("height_cm").isNotNull(),
                F.concat(F.lit("Height "), F.format_string("%.2f", F.col("height_cm")), F.lit("cm")),
            ),
            F.lit(""),
        ),
        F.coalesce(F.concat(F.lit(", Leaves "), F.col("leaf_count").cast("string")), F.lit("")),
        F.coalesce(F.concat(F.lit(", Health "), h.cast("string"), F.lit("/5")), F.lit("")),
    )
    # without the measuring type no event is written
    typed = accepted.withColumn("event_type_id", _type_id(t, measure)).where(F.col("event_type_id").isNotNull())
    events = typed.select(
        F.col("request_id").alias("id"),
        "plant_id",
        "event_type_id",
        now.alias("event_date"),
        text.alias("description"),
        F.lit(True).alias("is_completed"),
        now.alias("created_at"),
    )
    rejected = r.where(F.col("reject_reason").isNotNull()).select("request_id", "plant_id", "health_status", "reject_reason")
    out = {
        "measurements": measurements,
        "events": events,
        "warnings": health_warnings(measurements, t, as_of),
        "rejected": rejected,
    }
    if with_rule_1:
        out["reminders"] = event_reminders(events, t, as_of)
    return out


# ----------------------------------------------------------- rows for a table
def table_rows(produced: DataFrame, table: DataFrame, source: str, slots: int = 1, slot: int = 0) -> DataFrame:
    """Produced rows in the shape of ``table``, ready to append: its columns and
    order, NULL where the rule gives none, and an ``id`` of their own.

    Ids follow the table's greatest one: each source id (the request or event a
    row stems from, unique within the batch and not negative) owns ``slots`` of
    them, ``slot`` tells rules apart that write several rows per source.  Like
    a sequence this leaves gaps, and like none needs rows to be numbered in
    one place."""
    start = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("start")).scalar()
    new_id = start + F.col(source) * slots + (slot + 1)
    cols = []
    for f in table.schema.fields:
        if f.name == "id":
            cols.append(new_id.cast(f.dataType).alias("id"))
        elif f.name in produced.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return produced.select(*cols)
