"""The nine analytic views (V-1 .. V-9) as DataFrame functions.

Every view takes the table bundle and an explicit ``as_of`` (the source reads
the clock).  Views return unsorted DataFrames; the source's ``ORDER BY`` is
available as ``*_order()`` helpers for presentation (a global sort is a range
shuffle, paid only when a caller asks for it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.functions import labels as L
from tendril.functions.days import as_ts, calendar_days, whole_days
from tendril.operators.latest import latest_per_key, time_order
from tendril.operators.sequence import with_neighbours
from tendril.sources.tables import CareTables

REMINDER_PREFIX = "Reminder: "


def _plant_names(t: CareTables) -> DataFrame:
    return t.plants.select(F.col("id").alias("plant_id"), F.col("name").alias("plant_name"))


def _types(t: CareTables, *cols: str) -> DataFrame:
    """plant_types projected and renamed for a left join on plant_type_id."""
    return t.dim("plant_types").select(F.col("id").alias("plant_type_id"), *cols)


def _event_types(t: CareTables) -> DataFrame:
    return t.dim("event_types").select(
        F.col("id").alias("event_type_id"),
        F.col("name").alias("event_type_name"),
        F.col("color").alias("event_color"),
    )


def measurement_order() -> list[Column]:
    """Ascending time order of measurements (NULL dates last, ties by id)."""
    return [F.col("measurement_date").isNull(), F.col("measurement_date"), F.col("id")]


# --------------------------------------------------------------------- V-1
def plants_overview(t: CareTables, as_of) -> DataFrame:
    """Per plant (inactive too): type, age, image count, newest event, event
    count, newest measurement.  If the newest event has no (known) type, both
    last-event fields are NULL, as the source's inner join makes them."""
    now = as_ts(as_of)
    images = t.plant_images.groupBy("plant_id").agg(F.count(F.lit(1)).alias("image_count"))
    ev_order = F.struct(F.col("event_date"), F.col("id"))
    events = t.events.groupBy("plant_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.max_by(F.struct("event_date", "event_type_id"), ev_order).alias("_last"),
    )
    last_type = t.dim("event_types").select(F.col("id").alias("_tid"), F.col("name").alias("_tname"))
    events = events.join(last_type, F.col("_last.event_type_id") == F.col("_tid"), "left").select(
        "plant_id",
        "total_events",
        F.when(F.col("_tname").isNotNull(), F.col("_last.event_date")).alias("last_event_date"),
        F.col("_tname").alias("last_event_type"),
    )
    latest = latest_per_key(
        t.measurements, "plant_id", ["height_cm", "health_status", "measurement_date"], "measurement_date"
    ).select(
        "plant_id",
        F.col("height_cm").alias("last_height"),
        F.col("health_status").alias("last_health_status"),
        F.col("measurement_date").alias("last_measurement_date"),
    )
    p = t.plants.join(
        _types(t, F.col("name").alias("plant_type"), "scientific_name"), "plant_type_id", "left"
    )
    out = (
        p.join(images, p.id == images.plant_id, "left")
        .drop("plant_id")
        .join(events, p.id == events.plant_id, "left")
        .drop("plant_id")
        .join(latest, p.id == latest.plant_id, "left")
    )
    return out.select(
        p.id,
        p.name,
        "plant_type",
        "scientific_name",
        "planted_date",
        calendar_days(now, F.col("planted_date")).alias("days_old"),
        "location",
        "is_active",
        "created_at",
        F.coalesce("image_count", F.lit(0)).cast("long").alias("image_count"),
        "last_event_date",
        "last_event_type",
        F.coalesce("total_events", F.lit(0)).cast("long").alias("total_events"),
        "last_height",
        "last_health_status",
        "last_measurement_date",
    )


# --------------------------------------------------------------------- V-2
def events_detailed(t: CareTables, as_of) -> DataFrame:
    """Events with plant and type; whole days until; ``is_past`` is the
    source view's flag (ignores completion), ``is_overdue`` also needs the
    event not done (the model's rule)."""
    now = as_ts(as_of)
    e = t.events.join(_plant_names(t), "plant_id").join(_event_types(t), "event_type_id")
    past = F.col("event_date") < now
    return e.select(
        "id",
        "plant_id",
        "plant_name",
        "event_type_id",
        "event_type_name",
        "event_color",
        "event_date",
        "description",
        "notes",
        "reminder_date",
        "is_completed",
        "created_at",
        whole_days(F.col("event_date"), now).alias("days_until_event"),
        past.alias("is_past"),
        (past & ~F.coalesce(F.col("is_completed"), F.lit(False))).alias("is_overdue"),
    )


# --------------------------------------------------------------------- V-3
def plant_type_stats(t: CareTables, as_of) -> DataFrame:
    """Per plant type (also types without plants): plants, active plants,
    average age, average events per plant and average of the plants' mean
    health.  Plants without events / health rows are skipped in those means."""
    now = as_ts(as_of)
    ev = t.events.groupBy("plant_id").agg(F.count(F.lit(1)).alias("event_count"))
    hl = (
        t.measurements.where(F.col("health_status").isNotNull())
        .groupBy("plant_id")
        .agg((F.sum("health_status") / F.count("health_status")).alias("avg_health"))
    )
    p = (
        t.plants.select("id", "plant_type_id", "is_active", calendar_days(now, F.col("planted_date")).alias("age"))
        .join(ev, F.col("id") == ev.plant_id, "left")
        .drop("plant_id")
        .join(hl, F.col("id") == hl.plant_id, "left")
        .drop("plant_id")
    )
    per_type = p.groupBy("plant_type_id").agg(
        F.count("id").alias("total_plants"),
        F.count_if(F.col("is_active")).alias("active_plants"),
        F.sum("age").alias("_age_sum"),
        F.count("age").alias("_age_n"),
        F.sum("event_count").alias("_ev_sum"),
        F.count("event_count").alias("_ev_n"),
        F.avg("avg_health").alias("_health"),
    )
    types = t.dim("plant_types").select(F.col("id").alias("plant_type_id"), "name", "scientific_name")
    # One row per type (+ the untyped group): bounded by the checked catalog.
    out = types.join(per_type, "plant_type_id", "left")
    return out.select(
        F.col("plant_type_id").alias("id"),
        "name",
        "scientific_name",
        F.coalesce("total_plants", F.lit(0)).alias("total_plants"),
        F.coalesce("active_plants", F.lit(0)).alias("active_plants"),
        L.round_ratio(F.col("_age_sum"), F.col("_age_n"), 0).cast("int").alias("avg_age_days"),
        L.round_ratio(F.col("_ev_sum"), F.col("_ev_n"), 2).alias("avg_events_per_plant"),
        L.round_half_up(F.col("_health"), 2).alias("avg_health_status"),
    )


# --------------------------------------------------------------------- V-4
def growth_timeline(t: CareTables, as_of=None) -> DataFrame:
    """Per measurement with a height: previous height, growth, whole days
    since the previous measurement and UP / DOWN / FLAT (first rows FLAT).
    The height filter runs before the window, as in the source."""
    m = t.measurements.where(F.col("height_cm").isNotNull())
    m = with_neighbours(
        m, "plant_id", measurement_order(), ["height_cm", "measurement_date"], "measurement_date", prev=True
    )
    m = m.join(_plant_names(t), "plant_id")
    return m.select(
        "id",
        "plant_id",
        "plant_name",
        "measurement_date",
        "height_cm",
        "width_cm",
        "leaf_count",
        "health_status",
        F.col("prev_height_cm").alias("prev_height"),
        (F.col("height_cm") - F.col("prev_height_cm")).alias("height_growth"),
        whole_days(F.col("measurement_date"), F.col("prev_measurement_date")).alias("days_since_last_measurement"),
        L.compare_label("height_cm", "prev_height_cm", L.TREND_UP, L.TREND_DOWN, L.TREND_FLAT).alias("growth_trend"),
    )


# --------------------------------------------------------------------- V-5
def active_reminders(t: CareTables, as_of) -> DataFrame:
    """Pending reminders (NULL completion drops) with plant, type, whole days
    until and status OVERDUE / URGENT / SOON / FUTURE."""
    now = as_ts(as_of)
    r = (
        t.reminders.where(~F.col("is_completed"))
        .join(_plant_names(t), "plant_id")
        .join(_event_types(t), "event_type_id")
    )
    return r.select(
        "id",
        "plant_id",
        "plant_name",
        "event_type_id",
        "event_type_name",
        "event_color",
        "reminder_date",
        "message",
        "is_sent",
        "is_completed",
        whole_days(F.col("reminder_date"), now).alias("days_until_reminder"),
        L.reminder_status("reminder_date", "is_sent", "is_completed", now).alias("reminder_status"),
    )


# --------------------------------------------------------------------- V-6
def calendar(t: CareTables, as_of=None) -> DataFrame:
    """Events and pending reminders in one shape (UNION ALL)."""
    ev = t.events.select(
        F.lit("event").alias("item_type"), F.col("id").alias("item_id"), "plant_id", "event_type_id", "description",
        F.col("event_date").alias("date"), "is_completed", F.lit(False).alias("is_reminder"),
    )
    rm = t.reminders.where(~F.col("is_completed")).select(
        F.lit("reminder").alias("item_type"), F.col("id").alias("item_id"), "plant_id", "event_type_id",
        F.col("message").alias("description"), F.col("reminder_date").alias("date"), "is_completed",
        F.lit(True).alias("is_reminder"),
    )
    # union first, so that plants and types are joined once
    items = ev.unionByName(rm).join(_event_types(t), "event_type_id").join(_plant_names(t), "plant_id")
    title = F.when(F.col("is_reminder"), F.concat(F.lit(REMINDER_PREFIX), F.col("event_type_name")))
    return items.select(
        "item_type",
        "item_id",
        "plant_id",
        "plant_name",
        title.otherwise(F.col("event_type_name")).alias("title"),
        "description",
        "date",
        F.col("event_color").alias("color"),
        "is_completed",
        "is_reminder",
    )


# --------------------------------------------------------------------- V-7
def measurements_overview(t: CareTables, as_of) -> DataFrame:
    """Every measurement: health text, previous value and change of height,
    leaves and health, whole days ago and rank (1 = newest, NULL date first)."""
    now = as_ts(as_of)
    m = with_neighbours(
        t.measurements,
        "plant_id",
        measurement_order(),
        ["height_cm", "leaf_count", "health_status"],
        "measurement_date",
        prev=True,
        rank_desc="measurement_rank",
    )
    p = t.plants.select(F.col("id").alias("plant_id"), F.col("name").alias("plant_name"), "plant_type_id").join(
        _types(t, F.col("name").alias("plant_type")), "plant_type_id", "left"
    )
    m = m.join(p, "plant_id")
    return m.select(
        "id",
        "plant_id",
        "plant_name",
        "plant_type",
        "measurement_date",
        "height_cm",
        "width_cm",
        "leaf_count",
        "flower_count",
        "health_status",
        L.health_text_sql("health_status").alias("health_description"),
        "notes",
        F.col("prev_height_cm").alias("previous_height"),
        (F.col("height_cm") - F.col("prev_height_cm")).alias("height_change"),
        F.col("prev_leaf_count").alias("previous_leaves"),
        (F.col("leaf_count") - F.col("prev_leaf_count")).alias("leaf_change"),
        F.col("prev_health_status").alias("previous_health"),
        (F.col("health_status") - F.col("prev_health_status")).alias("health_change"),
        whole_days(now, F.col("measurement_date")).alias("days_ago"),
        "measurement_rank",
    )


# --------------------------------------------------------------------- V-8
def measurement_stats(measurements: DataFrame, as_of, window_days: int = 30) -> DataFrame:
    """One aggregate pass per plant: counts, first/last, maxima, health and
    the first/last height inside the look-back window."""
    now = as_ts(as_of)
    order = time_order("measurement_date")
    in_window = F.col("measurement_date") >= now - F.make_dt_interval(days=F.lit(window_days))
    vals = F.struct("height_cm", "leaf_count", "health_status")
    return measurements.groupBy("plant_id").agg(
        F.count("id").alias("total_measurements"),
        F.min("measurement_date").alias("first_measurement"),
        F.max("measurement_date").alias("last_measurement"),
        F.min_by(vals, order).alias("_first"),
        F.max_by(vals, order).alias("_last"),
        F.max("height_cm").alias("max_height_reached"),
        F.max("leaf_count").alias("max_leaves_reached"),
        F.sum("health_status").alias("_h_sum"),
        F.count("health_status").alias("_h_n"),
        F.min("health_status").alias("min_health_status"),
        F.max("health_status").alias("max_health_status"),
        F.count_if(in_window).alias("_w_n"),
        F.min_by(F.col("height_cm"), F.when(in_window, order)).alias("_w_first"),
        F.max_by(F.col("height_cm"), F.when(in_window, order)).alias("_w_last"),
    )


def growth_statistics(t: CareTables, as_of, window_days: int = 30, stats: DataFrame | None = None) -> DataFrame:
    """Per active plant: measurement count, first/last date and period, first
    / current / total / max height, leaves, health figures, 30-day trend
    (UP / DOWN / STABLE, INSUFFICIENT under two rows) and age.  ``stats``: figures
    per plant that are already there (``growth_state.stats_of``)."""
    now = as_ts(as_of)
    s = measurement_stats(t.measurements, as_of, window_days) if stats is None else stats
    p = t.plants.where(F.col("is_active")).join(_types(t, F.col("name").alias("plant_type")), "plant_type_id", "left")
    out = p.join(s, p.id == s.plant_id, "left")
    trend = F.when(
        F.coalesce(F.col("_w_n"), F.lit(0)) >= 2,
        L.compare_label("_w_last", "_w_first", L.TREND_UP, L.TREND_DOWN, L.TREND_STABLE),
    ).otherwise(F.lit(L.TREND_INSUFFICIENT))
    return out.select(
        p.id.alias("plant_id"),
        p.name.alias("plant_name"),
        "plant_type",
        F.coalesce("total_measurements", F.lit(0)).alias("total_measurements"),
        "first_measurement",
        "last_measurement",
        whole_days(F.col("last_measurement"), F.col("first_measurement")).alias("measurement_period_days"),
        F.col("_first.height_cm").alias("initial_height"),
        F.col("_last.height_cm").alias("current_height"),
        F.coalesce(F.col("_last.height_cm") - F.col("_first.height_cm"), F.lit(0.0)).alias("total_growth"),
        "max_height_reached",
        F.col("_first.leaf_count").alias("initial_leaves"),
        F.col("_last.leaf_count").alias("current_leaves"),
        "max_leaves_reached",
        L.round_ratio(F.col("_h_sum"), F.col("_h_n"), 2).alias("avg_health_status"),
        "min_health_status",
        "max_health_status",
        F.col("_last.health_status").alias("current_health_status"),
        trend.alias("growth_trend_30days"),
        "planted_date",
        calendar_days(now, F.col("planted_date")).alias("plant_age_days"),
    )


def growth_statistics_order() -> list[Column]:
    """The source's ORDER BY total_measurements DESC, name (plus id for ties)."""
    return [F.col("total_measurements").desc(), F.col("plant_name").asc(), F.col("plant_id").asc()]


# --------------------------------------------------------------------- V-9
def health_alerts(t: CareTables, as_of, stale_days: int = 30) -> DataFrame:
    """Active plants whose newest measurement has health <= 3, is older than
    ``stale_days`` whole days, or that have no measurement at all.  The level
    follows the source, so a plant without measurements is listed as OK."""
    now = as_ts(as_of)
    latest = latest_per_key(
        t.measurements, "plant_id", ["health_status", "measurement_date", "notes"], "measurement_date"
    ).select("plant_id", "health_status", "measurement_date", F.col("notes").alias("last_notes"), F.lit(True).alias("_has"))
    p = t.plants.where(F.col("is_active")).join(_types(t, F.col("name").alias("plant_type")), "plant_type_id", "left")
    out = p.join(latest, p.id == latest.plant_id, "left")
    h = F.col("health_status")
    days = whole_days(now, F.col("measurement_date"))
    stale = days > stale_days
    level = (
        F.when(h == 1, L.ALERT_CRITICAL)
        .when(h == 2, L.ALERT_BAD)
        .when(h == 3, L.ALERT_WARNING)
        .when(stale, L.ALERT_STALE)
        .otherwise(L.ALERT_OK)
    )
    msg = (
        F.when(h <= 2, L.ALERT_MESSAGES["bad"])
        .when(h == 3, L.ALERT_MESSAGES["stress"])
        .when(stale, L.ALERT_MESSAGES["stale"])
        .otherwise(L.ALERT_MESSAGES["ok"])
    )
    keep = (h <= 3) | stale | F.col("_has").isNull()
    return out.where(keep).select(
        p.id.alias("plant_id"),
        p.name.alias("plant_name"),
        "plant_type",
        h.alias("current_health"),
        F.col("measurement_date").alias("last_measurement_date"),
        days.alias("days_since_measurement"),
        level.alias("alert_level"),
        msg.alias("alert_message"),
        "last_notes",
    )


def alert_rank(level: Column) -> Column:
    """Severity rank of the alert list order (1 = most severe)."""
    return (
        F.when(level == L.ALERT_CRITICAL, 1)
        .when(level == L.ALERT_BAD, 2)
        .when(level == L.ALERT_WARNING, 3)
        .when(level == L.ALERT_STALE, 4)
        .otherwise(5)
    )


def health_alerts_order() -> list[Column]:
    """The source's alert order: severity, then health (plus id for ties)."""
    return [alert_rank(F.col("alert_level")), F.col("current_health").asc_nulls_last(), F.col("plant_id")]


def reminder_rows(reminders: DataFrame, now: Column) -> DataFrame:
    """The model's reminder fields: status and calendar days until."""
    return reminders.withColumn(
        "status", L.reminder_status("reminder_date", "is_sent", "is_completed", now)
    ).withColumn("days_until", calendar_days(F.col("reminder_date"), now))
