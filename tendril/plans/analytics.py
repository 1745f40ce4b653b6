"""Functions over all plants at once (FN-1 .. FN-20).

The source computes most of these for one plant per page request; here each
is one plan over every key, and a caller filters keys afterwards (the filter
on the group key is pushed below the aggregate by Catalyst).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.functions import labels as L
from tendril.functions.days import add_days, as_ts, calendar_days, floor_days, whole_days
from tendril.operators.latest import latest_per_key, time_order
from tendril.operators.paging import page, top_k, top_k_per_key
from tendril.plans.views import _event_types, _plant_names, _types, measurement_stats, reminder_rows
from tendril.sources.tables import CareTables

WATER = "WATER"
FERTILIZE = "FERTILIZE"
SPRAY = "SPRAY"
MEASURE = "MEASURE"

PLANTS_PAGE, EVENTS_PAGE, MEASUREMENTS_PAGE, IMAGES_PAGE = 12, 20, 20, 24


def _active(t: CareTables) -> DataFrame:
    return t.plants.where(F.col("is_active"))


def _active_ids(t: CareTables) -> DataFrame:
    return _active(t).select(F.col("id").alias("plant_id"), F.col("name").alias("plant_name"))


# --------------------------------------------------------------------- FN-1
def active_plants(t: CareTables, as_of) -> DataFrame:
    """Active plants with type name and calendar days since planting."""
    now = as_ts(as_of)
    p = _active(t).join(_types(t, F.col("name").alias("plant_type_name")), "plant_type_id", "left")
    return p.select(
        "id",
        "name",
        "plant_type_name",
        "planted_date",
        "location",
        calendar_days(now, F.col("planted_date")).alias("days_since_planted"),
        "created_at",
    )


# --------------------------------------------------------------------- FN-4
def growth_stats(t: CareTables, as_of=None) -> DataFrame:
    """Twelve growth figures per plant (every plant, active or not)."""
    s = measurement_stats(t.measurements, as_of or "1970-01-01 00:00:00")
    out = t.plants.join(s, t.plants.id == s.plant_id, "left")
    return out.select(
        t.plants.id.alias("plant_id"),
        t.plants.name.alias("plant_name"),
        F.coalesce("total_measurements", F.lit(0)).cast("int").alias("total_measurements"),
        F.col("first_measurement").alias("first_measurement_date"),
        F.col("last_measurement").alias("last_measurement_date"),
        F.col("_last.height_cm").alias("current_height_cm"),
        F.col("max_height_reached").alias("max_height_cm"),
        F.coalesce(F.col("_last.height_cm") - F.col("_first.height_cm"), F.lit(0.0)).alias("height_growth_cm"),
        F.col("_last.leaf_count").alias("current_leaf_count"),
        F.col("max_leaves_reached").alias("max_leaf_count"),
        F.col("_last.health_status").alias("current_health_status"),
        L.round_ratio(F.col("_h_sum"), F.col("_h_n"), 2).alias("avg_health_status"),
    )


# --------------------------------------------------------------------- FN-5
def needs_attention(
    t: CareTables, as_of, min_days: int = 5, medium_days: int = 7, high_days: int = 14, water_type: str = WATER
) -> DataFrame:
    """Two reasons, UNION ALL (a plant may appear twice):
    (a) active plants whose last completed watering (else creation) is more
        than ``min_days`` whole days ago - urgency 3 / 2 / 1 above 14 / 7 days;
    (b) active plants whose newest non-NULL health is <= 3 - urgency 3 / 2."""
    now = as_ts(as_of)
    water_ids = t.dim("event_types").where(F.col("name") == water_type).select(F.col("id").alias("event_type_id"))
    last_water = (
        t.events.where(F.col("is_completed") == True)  # noqa: E712  (NULL drops)
        .join(water_ids, "event_type_id", "left_semi")
        .groupBy("plant_id")
        .agg(F.max("event_date").alias("last_water"))
    )
    p = _active(t)
    a = p.join(last_water, p.id == last_water.plant_id, "left")
    days = whole_days(now, F.coalesce(F.col("last_water"), F.col("created_at")))
    water = a.where(days > min_days).select(
        p.id.alias("plant_id"),
        p.name.alias("plant_name"),
        F.concat(F.lit("Not watered for "), days.cast("string"), F.lit(" days")).alias("reason"),
        F.when(days > high_days, 3).when(days > medium_days, 2).otherwise(1).alias("urgency"),
        F.col("last_water").alias("last_event_date"),
    )
    latest_h = latest_per_key(
        t.measurements,
        "plant_id",
        ["health_status", "measurement_date"],
        "measurement_date",
        where=F.col("health_status").isNotNull(),
    )
    b = p.join(latest_h, p.id == latest_h.plant_id).where(F.col("health_status") <= 3)
    health = b.select(
        p.id.alias("plant_id"),
        p.name.alias("plant_name"),
        F.concat(F.lit("Poor health - "), F.col("health_status").cast("string"), F.lit("/5")).alias("reason"),
        F.when(F.col("health_status") <= 2, 3).when(F.col("health_status") == 3, 2).otherwise(1).alias("urgency"),
        F.col("measurement_date").alias("last_event_date"),
    )
    out = water.unionByName(health)
    return out.withColumn("urgency_label", L.urgency_label("urgency"))


def needs_attention_order() -> list[Column]:
    return [F.col("urgency").desc(), F.col("last_event_date").asc_nulls_last(), F.col("plant_id"), F.col("reason")]


# --------------------------------------------------------------------- FN-6
def upcoming_reminders(t: CareTables, as_of, days_ahead: int = 7) -> DataFrame:
    """Unsent, open reminders with ``as_of <= date <= as_of + days_ahead``
    (both ends closed); inactive plants are not filtered (as the source)."""
    from tendril.sources.layout import between

    now = as_ts(as_of)
    r = between(t.reminders, "reminder_date", now, days_ahead).where(
        (F.col("is_sent") == False) & (F.col("is_completed") == False)  # noqa: E712
    )
    r = r.join(_plant_names(t), "plant_id").join(_event_types(t), "event_type_id")
    return r.select(
        F.col("id").alias("reminder_id"),
        "plant_name",
        "event_type_name",
        "reminder_date",
        "message",
        whole_days(F.col("reminder_date"), now).alias("days_until"),
    )


# --------------------------------------------------------------------- FN-7
def measurement_trend(t: CareTables, as_of, days_back: int = 30, plant_ids: DataFrame | None = None) -> DataFrame:
    """Measurements of the last ``days_back`` days (no upper end), whole days ago."""
    from tendril.sources.layout import since

    now = as_ts(as_of)
    m = since(t.measurements, "measurement_date", add_days(now, -days_back))
    if plant_ids is not None:
        m = m.join(plant_ids, "plant_id", "left_semi")
    return m.select(
        "plant_id",
        "id",
        "measurement_date",
        "height_cm",
        "width_cm",
        "leaf_count",
        "health_status",
        "notes",
        whole_days(now, F.col("measurement_date")).alias("days_ago"),
    )


# --------------------------------------------------------------------- FN-8
def health_analysis(t: CareTables, as_of, avg_days: int = 90, stale_days: int = 30) -> DataFrame:
    """Per active plant: newest health, ``avg_days`` average, trend against the
    unrounded average (IMPROVING / WORSENING / STABLE), whole days since and
    an attention flag (health <= 2 or stale; no measurement -> false)."""
    now = as_ts(as_of)
    in_window = F.col("measurement_date") >= add_days(now, -avg_days)
    agg = t.measurements.groupBy("plant_id").agg(
        F.max_by(F.struct("health_status", "measurement_date"), time_order("measurement_date")).alias("_last"),
        F.sum(F.when(in_window, F.col("health_status"))).alias("_s"),
        F.count(F.when(in_window, F.col("health_status"))).alias("_n"),
        F.count_if(in_window).alias("_rows"),
    )
    p = _active(t).join(_types(t, F.col("name").alias("plant_type")), "plant_type_id", "left")
    out = p.join(agg, p.id == agg.plant_id, "left")
    cur = F.col("_last.health_status")
    avg = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))
    days = whole_days(now, F.col("_last.measurement_date"))
    return out.select(
        p.id.alias("plant_id"),
        p.name.alias("plant_name"),
        "plant_type",
        cur.alias("current_health_status"),
        L.round_ratio(F.col("_s"), F.col("_n"), 2).alias("avg_health_status"),
        F.when(cur > avg, "IMPROVING").when(cur < avg, "WORSENING").otherwise("STABLE").alias("health_trend"),
        F.col("_last.measurement_date").alias("last_measurement_date"),
        days.alias("days_since_measurement"),
        F.when(cur <= 2, True).when(days > stale_days, True).otherwise(False).alias("needs_attention"),
    )


# --------------------------------------------------------------------- FN-9
def plant_card_flags(t: CareTables, as_of, stale_days: int = 30) -> DataFrame:
    """The model's attention rule per active plant: no measurement -> true;
    newest measurement more than ``stale_days`` (floored) days old -> true;
    newest health 1..2 -> true; else false.  Staleness is tested first."""
    now = as_ts(as_of)
    latest = latest_per_key(t.measurements, "plant_id", ["health_status", "measurement_date"], "measurement_date")
    latest = latest.withColumn("_has", F.lit(True))
    p = _active(t)
    out = p.join(latest, p.id == latest.plant_id, "left")
    h = F.col("health_status")
    days = floor_days(now, F.col("measurement_date"))
    poor = h.isNotNull() & (h != 0) & (h <= 2)
    flag = F.when(F.col("_has").isNull(), True).when(days > stale_days, True).when(poor, True).otherwise(False)
    reason = (
        F.when(F.col("_has").isNull(), F.lit("No measurements"))
        .when(days > stale_days, F.concat(F.lit("Last measurement "), days.cast("string"), F.lit(" days ago")))
        .when(poor, F.concat(F.lit("Poor health ("), L.health_text_app(h), F.lit(")")))
        .otherwise(F.lit("In good condition"))
    )
    return out.select(p.id.alias("plant_id"), p.name.alias("plant_name"), flag.alias("needs_attention"), reason.alias("reason"))


# --------------------------------------------------------------- FN-10, FN-11
def height_trends(t: CareTables, as_of, window_days: int = 30) -> DataFrame:
    """Per plant, over non-NULL heights only: the 30-day trend (UP / DOWN /
    STABLE, INSUFFICIENT under two rows) and total growth (last - first,
    NULL under two rows)."""
    now = as_ts(as_of)
    m = t.measurements.where(F.col("height_cm").isNotNull())
    order = time_order("measurement_date")
    in_window = F.col("measurement_date") >= add_days(now, -window_days)
    agg = m.groupBy("plant_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("height_cm", order).alias("_first"),
        F.max_by("height_cm", order).alias("_last"),
        F.count_if(in_window).alias("_wn"),
        F.min_by("height_cm", F.when(in_window, order)).alias("_wfirst"),
        F.max_by("height_cm", F.when(in_window, order)).alias("_wlast"),
    )
    out = t.plants.join(agg, t.plants.id == agg.plant_id, "left")
    trend = F.when(F.coalesce(F.col("_wn"), F.lit(0)) < 2, F.lit(L.TREND_INSUFFICIENT)).otherwise(
        L.compare_label("_wlast", "_wfirst", L.TREND_UP, L.TREND_DOWN, L.TREND_STABLE)
    )
    return out.select(
        t.plants.id.alias("plant_id"),
        trend.alias("growth_trend"),
        F.when(F.col("_n") >= 2, F.col("_last") - F.col("_first")).alias("total_growth"),
    )


# --------------------------------------------------------------------- FN-12
def latest_measurement(t: CareTables) -> DataFrame:
    """Per plant: newest measurement, current height (0 -> NULL), health and
    its text (no measurement -> NO_MEASUREMENT)."""
    cols = ["id", "measurement_date", "height_cm", "leaf_count", "health_status"]
    latest = latest_per_key(t.measurements, "plant_id", cols, "measurement_date", prefix="m_")
    latest = latest.withColumn("_has", F.lit(True))
    out = t.plants.join(latest, t.plants.id == latest.plant_id, "left")
    h = F.col("m_health_status")
    return out.select(
        t.plants.id.alias("plant_id"),
        F.col("m_id").alias("measurement_id"),
        F.col("m_measurement_date").alias("measurement_date"),
        F.when(F.col("m_height_cm") != 0, F.col("m_height_cm")).alias("current_height"),
        h.alias("current_health_status"),
        F.when(F.col("_has").isNull(), F.lit(L.NO_MEASUREMENT)).otherwise(L.health_text_app(h)).alias(
            "current_health_text"
        ),
    )


# --------------------------------------------------------------------- FN-13
def dashboard_metrics(t: CareTables, as_of, days_ahead: int = 7) -> DataFrame:
    """One row: active plants, all events, upcoming reminders, attention rows."""
    plants = _active(t).agg(F.count(F.lit(1)).alias("total_plants"))
    events = t.events.agg(F.count(F.lit(1)).alias("total_events"))
    upcoming = upcoming_reminders(t, as_of, days_ahead).agg(F.count(F.lit(1)).alias("upcoming_reminders"))
    attention = needs_attention(t, as_of).agg(F.count(F.lit(1)).alias("plants_needing_attention"))
    # Four one-row aggregates side by side (scalar sub-queries, no pairs).
    return plants.select(
        "total_plants",
        events.scalar().alias("total_events"),
        upcoming.scalar().alias("upcoming_reminders"),
        attention.scalar().alias("plants_needing_attention"),
    )


def top_attention(t: CareTables, as_of, k: int = 3) -> DataFrame:
    """Dashboard: the first k attention rows (urgency, then oldest date; ties
    by plant and reason)."""
    return top_k(needs_attention(t, as_of), needs_attention_order(), k)


def top_upcoming(t: CareTables, as_of, k: int = 5, days_ahead: int = 7) -> DataFrame:
    """Dashboard: the next k upcoming reminders with the dashboard badge."""
    up = upcoming_reminders(t, as_of, days_ahead).withColumn("badge", L.due_badge(F.col("days_until")))
    return top_k(up, [F.col("reminder_date").asc(), F.col("reminder_id").asc()], k)


def recent_events(t: CareTables, k: int = 5) -> DataFrame:
    """k newest events (by creation) of active plants that have a type."""
    e = t.events.join(_active_ids(t), "plant_id").join(_event_types(t), "event_type_id")
    e = e.select("id", "plant_id", "plant_name", "event_type_name", "event_date", "description", "created_at")
    return top_k(e, [F.col("created_at").desc_nulls_first(), F.col("id").desc()], k)


def recent_images(t: CareTables, k: int = 6) -> DataFrame:
    """k newest images of active plants."""
    i = t.plant_images.join(_active_ids(t), "plant_id")
    i = i.select("id", "plant_id", "plant_name", "filename", "upload_date", "file_size")
    return top_k(i, [F.col("upload_date").desc_nulls_first(), F.col("id").desc()], k)


# --------------------------------------------------------------------- FN-14
def plant_cards(
    t: CareTables,
    page_no: int = 1,
    search: str = "",
    plant_type_id: int = 0,
    size: int = PLANTS_PAGE,
    as_of=None,
) -> DataFrame:
    """The plant list page: active plants, optional name search (``%``/``_``
    act as wildcards, as in the source) and type filter, newest first, with
    type, planting date, age text, counts of events / images / measurements,
    newest health (+ text) and the first image."""
    from tendril.functions.days import format_date

    now = as_ts(as_of)
    p = _active(t)
    if search:
        p = p.where(F.col("name").like(f"%{search}%"))
    if plant_type_id and plant_type_id > 0:
        p = p.where(F.col("plant_type_id") == plant_type_id)
    p = page(p, [F.col("created_at").desc_nulls_first(), F.col("id").desc()], page_no, size)
    # The page holds at most `size` plants: a proven bound, so the page and
    # everything aggregated for it are broadcast - no fact table is shuffled.
    ids = F.broadcast(p.select(F.col("id").alias("plant_id")))
    ev = t.events.join(ids, "plant_id", "left_semi").groupBy("plant_id").agg(F.count(F.lit(1)).alias("event_count"))
    im = (
        t.plant_images.join(ids, "plant_id", "left_semi")
        .groupBy("plant_id")
        .agg(
            F.count(F.lit(1)).alias("image_count"),
            F.min_by("filename", F.struct(F.col("upload_date").isNull(), "upload_date", "id")).alias("first_image"),
        )
    )
    ms = (
        t.measurements.join(ids, "plant_id", "left_semi")
        .groupBy("plant_id")
        .agg(
            F.count(F.lit(1)).alias("measurement_count"),
            F.max_by("health_status", time_order("measurement_date")).alias("latest_health"),
        )
    )
    out = p.join(F.broadcast(ev), p.id == ev.plant_id, "left").drop("plant_id")
    out = out.join(F.broadcast(im), out.id == im.plant_id, "left").drop("plant_id")
    out = out.join(F.broadcast(ms), out.id == ms.plant_id, "left").drop("plant_id")
    out = out.join(_types(t, F.col("name").alias("plant_type"), "scientific_name"), "plant_type_id", "left")
    age = calendar_days(now, F.col("planted_date"))
    return out.select(
        "id",
        "name",
        "plant_type_id",
        "plant_type",
        "scientific_name",
        format_date("planted_date").alias("planted_text"),
        L.age_text(age).alias("age_text"),
        "location",
        "created_at",
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
        F.coalesce("image_count", F.lit(0)).alias("image_count"),
        F.coalesce("measurement_count", F.lit(0)).alias("measurement_count"),
        "latest_health",
        F.when(F.col("latest_health").isNotNull(), L.health_text_app("latest_health")).alias("latest_health_text"),
        "first_image",
    )


# --------------------------------------------------------------------- FN-15
def detail_events(t: CareTables, k: int = 10) -> DataFrame:
    """Per plant, its k newest events (rank 1 = newest)."""
    e = t.events.select("id", "plant_id", "event_type_id", "event_date", "description", "is_completed")
    return top_k_per_key(e, "plant_id", [F.col("event_date").desc(), F.col("id").desc()], k)


def detail_measurements(t: CareTables, k: int = 5) -> DataFrame:
    """Per plant, its k newest measurements (NULL dates first, as the source)."""
    m = t.measurements.select("id", "plant_id", "measurement_date", "height_cm", "leaf_count", "health_status")
    order = [F.col("measurement_date").isNull().desc(), F.col("measurement_date").desc(), F.col("id").desc()]
    return top_k_per_key(m, "plant_id", order, k)


def detail_reminders(t: CareTables) -> DataFrame:
    """Per plant, its open reminders (completion FALSE; NULL is not open)."""
    return t.reminders.where(F.col("is_completed") == False).select(  # noqa: E712
        "id", "plant_id", "event_type_id", "reminder_date", "message", "is_sent"
    )


# --------------------------------------------------------------------- FN-16
def event_list(
    t: CareTables, as_of, page_no: int = 1, plant_id: int = 0, event_type_id: int = 0, size: int = EVENTS_PAGE
) -> DataFrame:
    """Events of active plants, optional plant / type filter, newest first,
    one page, with calendar days until, due label and status badge."""
    now = as_ts(as_of)
    e = t.events.join(_active_ids(t), "plant_id")
    if plant_id and plant_id > 0:
        e = e.where(F.col("plant_id") == plant_id)
    if event_type_id and event_type_id > 0:
        e = e.where(F.col("event_type_id") == event_type_id)
    e = page(e, [F.col("event_date").desc(), F.col("id").desc()], page_no, size)
    days = calendar_days(F.col("event_date"), now)
    return e.select(
        "id",
        "plant_id",
        "plant_name",
        "event_type_id",
        "event_date",
        L.truncate_text("description", 50).alias("description_short"),
        L.truncate_text("notes", 30).alias("notes_short"),
        "is_completed",
        days.alias("days_until"),
        L.due_label(days).alias("due_label"),
        L.event_status("event_date", "is_completed", days, now).alias("status"),
    )


# --------------------------------------------------------------------- FN-17
def measurement_list(t: CareTables, page_no: int = 1, plant_id: int = 0, size: int = MEASUREMENTS_PAGE) -> DataFrame:
    """Measurements of active plants, newest first (NULL dates first), one page."""
    m = t.measurements.join(_active_ids(t), "plant_id")
    if plant_id and plant_id > 0:
        m = m.where(F.col("plant_id") == plant_id)
    order = [F.col("measurement_date").desc_nulls_first(), F.col("id").desc()]
    m = page(m, order, page_no, size)
    return m.select(
        "id",
        "plant_id",
        "plant_name",
        "measurement_date",
        "height_cm",
        "leaf_count",
        "health_status",
        L.health_text_app("health_status").alias("health_text"),
        L.truncate_text("notes", 50).alias("notes_short"),
    )


# --------------------------------------------------------------------- FN-18
def image_list(t: CareTables, page_no: int = 1, plant_id: int = 0, size: int = IMAGES_PAGE) -> DataFrame:
    """Images of active plants, newest first, one page, size in MB (1 decimal)."""
    i = t.plant_images.join(_active_ids(t), "plant_id")
    if plant_id and plant_id > 0:
        i = i.where(F.col("plant_id") == plant_id)
    i = page(i, [F.col("upload_date").desc_nulls_first(), F.col("id").desc()], page_no, size)
    return i.select(
        "id",
        "plant_id",
        "plant_name",
        "filename",
        "upload_date",
        "file_size",
        F.round(F.col("file_size") / F.lit(1048576.0), 1).alias("size_mb"),
    )


# --------------------------------------------------------------------- FN-19
def reminder_board(t: CareTables, as_of) -> DataFrame:
    """Open reminders of active plants (no type join: untyped ones stay),
    with status, calendar days until and due label."""
    now = as_ts(as_of)
    r = reminder_rows(t.reminders.where(F.col("is_completed") == False), now)  # noqa: E712
    r = r.join(_active_ids(t), "plant_id")
    return r.select(
        "id",
        "plant_id",
        "plant_name",
        "event_type_id",
        "reminder_date",
        "message",
        "is_sent",
        "status",
        "days_until",
        L.due_label(F.col("days_until")).alias("due_label"),
    )


def reminder_status_counts(t: CareTables, as_of) -> DataFrame:
    """A-10: one row of counts per status plus the total."""
    b = reminder_board(t, as_of)
    s = F.col("status")
    return b.agg(
        F.count_if(s == L.REMINDER_OVERDUE).alias("overdue"),
        F.count_if(s == L.REMINDER_URGENT).alias("urgent"),
        F.count_if(s == L.REMINDER_SOON).alias("soon"),
        F.count_if(s == L.REMINDER_FUTURE).alias("future"),
        F.count(F.lit(1)).alias("total"),
    )


# --------------------------------------------------------------------- F-10
def event_search(
    t: CareTables,
    date_from=None,
    date_to=None,
    text: str = "",
    event_type_id: int = 0,
    plant_id: int = 0,
) -> DataFrame:
    """The search form: event date within ``[date_from, date_to]`` (whole
    days, both inclusive), description containing ``text`` (``%``/``_`` act
    as wildcards, as in the source), optional type and plant."""
    e = t.events
    if date_from is not None:
        e = e.where(F.col("event_date") >= as_ts(date_from))
    if date_to is not None:
        e = e.where(F.col("event_date") < add_days(as_ts(date_to), 1))
    if text:
        e = e.where(F.col("description").like(f"%{text}%"))
    if event_type_id and event_type_id > 0:
        e = e.where(F.col("event_type_id") == event_type_id)
    if plant_id and plant_id > 0:
        e = e.where(F.col("plant_id") == plant_id)
    return e.select("id", "plant_id", "event_type_id", "event_date", "description", "is_completed")


# ---------------------------------------------------------------- D-3, D-6
def plant_age_labels(t: CareTables, as_of) -> DataFrame:
    """Per plant: calendar days since planting, the age text and the
    planting / creation dates formatted for display."""
    from tendril.functions.days import format_date

    now = as_ts(as_of)
    days = calendar_days(now, F.col("planted_date"))
    return t.plants.select(
        "id",
        days.alias("days_since_planted"),
        L.age_text(days).alias("age_text"),
        format_date("planted_date").alias("planted_text"),
        format_date("created_at", with_time=True).alias("created_text"),
    )


def detail_images(t: CareTables) -> DataFrame:
    """FN-15: every image per plant, newest first (rank 1 = newest, NULL
    dates first).  Unbounded per plant, so the rank goes through the
    skew-safe ordered-neighbours operator rather than one window per key."""
    from tendril.operators.sequence import with_neighbours

    i = t.plant_images.select("id", "plant_id", "filename", "upload_date", "file_size")
    order = [F.col("upload_date").isNull(), F.col("upload_date"), F.col("id")]
    return with_neighbours(i, "plant_id", order, ["id"], "upload_date", prev=False, rank_desc="rank")
