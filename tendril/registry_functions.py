"""Registered queries: functions (FN-1 .. FN-20)."""

from __future__ import annotations

from tendril.plans import analytics as A
from tendril.registry import EV, M_ASC, M_DESC, MS, T, cd, register, rr, wd
from tendril.sources.roles import EVENTS_AS_OF, MEASURE_AS_OF


def fd(a: str, b: str) -> str:
    """Floored days of a - b (Python timedelta.days)."""
    return f"CAST(floor((epoch_us({a}) - epoch_us({b})) / 86400000000.0) AS INTEGER)"


def latest_m(where: str = "") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY {M_DESC}) AS rn
               FROM measurements {where}) x WHERE rn = 1"""


def trunc_sql(col: str, n: int) -> str:
    return f"CASE WHEN length({col}) > {n} THEN substr({col}, 1, {n}) || '...' ELSE {col} END"


def due_sql(d: str) -> str:
    return (
        f"CASE WHEN {d} < 0 THEN CAST(abs({d}) AS VARCHAR) || ' days late' WHEN {d} = 0 THEN 'today' "
        f"WHEN {d} = 1 THEN 'tomorrow' ELSE 'in ' || CAST({d} AS VARCHAR) || ' days' END"
    )


HEALTH_APP = """CASE WHEN {h} IS NULL OR {h} = 0 THEN 'NOT_MEASURED' WHEN {h} = 1 THEN 'VERY_POOR'
     WHEN {h} = 2 THEN 'POOR' WHEN {h} = 3 THEN 'FAIR' WHEN {h} = 4 THEN 'GOOD' WHEN {h} = 5 THEN 'EXCELLENT'
     ELSE 'UNKNOWN' END"""

REMINDER_STATUS = """CASE WHEN r.is_completed THEN 'DONE'
     WHEN r.reminder_date < {now} AND NOT r.is_sent THEN 'OVERDUE'
     WHEN r.reminder_date <= {now} + INTERVAL 1 DAY THEN 'URGENT'
     WHEN r.reminder_date <= {now} + INTERVAL 3 DAY THEN 'SOON' ELSE 'FUTURE' END"""


@register(
    "active_plants",
    f"""
SELECT id, name, plant_type_name, planted_date, location, {cd(MS, 'planted_date')} AS days_since_planted, created_at
FROM (FROM plants WHERE is_active)
LEFT JOIN (SELECT id AS plant_type_id, name AS plant_type_name FROM plant_types) USING (plant_type_id)""",
)
def q_active_plants(spark, sf_dir):
    return A.active_plants(T(spark, sf_dir), MEASURE_AS_OF)


@register(
    "growth_stats",
    f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY {M_ASC}) AS ra,
                     row_number() OVER (PARTITION BY plant_id ORDER BY {M_DESC}) AS rd FROM measurements),
a AS (SELECT plant_id, count(id) AS n, min(measurement_date) AS first_d, max(measurement_date) AS last_d,
             max(height_cm) AS max_h, max(leaf_count) AS max_l, sum(health_status) AS hs, count(health_status) AS hn
      FROM measurements GROUP BY plant_id)
SELECT p.id AS plant_id, p.name AS plant_name, CAST(COALESCE(a.n, 0) AS INTEGER) AS total_measurements,
       a.first_d AS first_measurement_date, a.last_d AS last_measurement_date, l.height_cm AS current_height_cm,
       a.max_h AS max_height_cm, COALESCE(l.height_cm - f.height_cm, 0) AS height_growth_cm,
       l.leaf_count AS current_leaf_count, a.max_l AS max_leaf_count, l.health_status AS current_health_status,
       {rr('a.hs', 'a.hn', 2)} AS avg_health_status
FROM plants p LEFT JOIN a ON a.plant_id = p.id
LEFT JOIN (SELECT * FROM r WHERE ra = 1) f ON f.plant_id = p.id
LEFT JOIN (SELECT * FROM r WHERE rd = 1) l ON l.plant_id = p.id""",
)
def q_growth_stats(spark, sf_dir):
    return A.growth_stats(T(spark, sf_dir))


# Rows per reason with the figure that is judged, then one table of bands for both.
NEEDS_ATTENTION_SQL = f"""
WITH band(kind, low, high, urgency) AS (VALUES
  ('water', 6, 7, 1), ('water', 8, 14, 2), ('water', 15, NULL, 3), ('health', NULL, 2, 3), ('health', 3, 3, 2)),
watered AS (SELECT plant_id, max(event_date) AS watered_at FROM care_events
            WHERE is_completed AND event_type_id IN (SELECT id FROM event_types WHERE name = 'WATER') GROUP BY plant_id),
rated AS (SELECT plant_id, arg_max(m, row(measurement_date IS NULL, measurement_date, id)) AS m FROM measurements m
          WHERE health_status IS NOT NULL GROUP BY plant_id),
alive AS (SELECT id AS plant_id, name AS plant_name, created_at FROM plants WHERE is_active),
figure AS (
  SELECT plant_id, plant_name, 'water' AS kind, {wd(EV, "ifnull(watered_at, created_at)")} AS v, watered_at AS last_event_date
  FROM alive LEFT JOIN watered USING (plant_id)
  UNION ALL
  SELECT plant_id, plant_name, 'health', m.health_status, m.measurement_date FROM alive JOIN rated USING (plant_id))
SELECT plant_id, plant_name,
       IF(kind = 'water', format('Not watered for {{}} days', v), format('Poor health - {{}}/5', v)) AS reason,
       urgency, last_event_date, (['LOW', 'MEDIUM', 'HIGH'])[urgency] AS urgency_label
FROM figure JOIN band USING (kind) WHERE v >= ifnull(low, v) AND v <= ifnull(high, v)"""


@register("needs_attention", NEEDS_ATTENTION_SQL)
def q_needs_attention(spark, sf_dir):
    return A.needs_attention(T(spark, sf_dir), EVENTS_AS_OF)


# Unsent open reminders that fall due from now on, within seven days.
DUE_CTE = f"""due AS (
  SELECT id AS reminder_id, plant_id, event_type_id, reminder_date, message, {wd('reminder_date', EV)} AS days_until
  FROM reminders
  WHERE is_sent = FALSE AND is_completed = FALSE
    AND epoch_us(reminder_date) - epoch_us({EV}) BETWEEN 0 AND 7 * 86400000000),
owners AS (SELECT id AS plant_id, name AS plant_name FROM plants),
kinds AS (SELECT id AS event_type_id, name AS event_type_name FROM event_types)"""


@register(
    "upcoming_reminders",
    f"""
WITH {DUE_CTE}
SELECT * EXCLUDE (plant_id, event_type_id) FROM due JOIN kinds USING (event_type_id) JOIN owners USING (plant_id)""",
)
def q_upcoming_reminders(spark, sf_dir):
    return A.upcoming_reminders(T(spark, sf_dir), EVENTS_AS_OF, 7)


@register(
    "measurement_trend",
    f"""
SELECT plant_id, id, measurement_date, height_cm, width_cm, leaf_count, health_status, notes,
       {wd(MS, 'measurement_date')} AS days_ago
FROM measurements WHERE measurement_date >= {MS} - INTERVAL 30 DAY""",
)
def q_measurement_trend(spark, sf_dir):
    return A.measurement_trend(T(spark, sf_dir), MEASURE_AS_OF, 30)


@register(
    "health_analysis",
    f"""
WITH newest AS (SELECT plant_id, arg_max(m, row(measurement_date IS NULL, measurement_date, id)) AS m FROM measurements m
                GROUP BY plant_id),
quarter AS (SELECT plant_id, sum(health_status) AS s, count(health_status) AS n FROM measurements
            WHERE measurement_date >= {MS} - INTERVAL 90 DAY GROUP BY plant_id),
one AS (SELECT id AS plant_id, name AS plant_name, plant_type_id, m.health_status AS h, m.measurement_date AS seen,
               {wd(MS, 'm.measurement_date')} AS age, s, n
        FROM plants LEFT JOIN newest ON newest.plant_id = id LEFT JOIN quarter ON quarter.plant_id = id WHERE is_active)
SELECT plant_id, plant_name, t.name AS plant_type, h AS current_health_status,
       {rr('s', 'n', 2)} AS avg_health_status,
       ifnull((['WORSENING', 'STABLE', 'IMPROVING'])[CAST(sign(h * n - s) AS INTEGER) + 2], 'STABLE') AS health_trend,
       seen AS last_measurement_date, age AS days_since_measurement,
       ifnull(h <= 2, FALSE) OR ifnull(age > 30, FALSE) AS needs_attention
FROM one LEFT JOIN plant_types t ON t.id = plant_type_id""",
)
def q_health_analysis(spark, sf_dir):
    return A.health_analysis(T(spark, sf_dir), MEASURE_AS_OF)


_FD = fd(MS, "lm.measurement_date")
_POOR = "lm.health_status IS NOT NULL AND lm.health_status <> 0 AND lm.health_status <= 2"


@register(
    "plant_card_flags",
    f"""
WITH lm AS ({latest_m()})
SELECT p.id AS plant_id, p.name AS plant_name,
       CASE WHEN lm.plant_id IS NULL THEN TRUE WHEN {_FD} > 30 THEN TRUE WHEN {_POOR} THEN TRUE
            ELSE FALSE END AS needs_attention,
       CASE WHEN lm.plant_id IS NULL THEN 'No measurements'
            WHEN {_FD} > 30 THEN 'Last measurement ' || CAST({_FD} AS VARCHAR) || ' days ago'
            WHEN {_POOR} THEN 'Poor health (' || {HEALTH_APP.format(h='lm.health_status')} || ')'
            ELSE 'In good condition' END AS reason
FROM plants p LEFT JOIN lm ON lm.plant_id = p.id WHERE p.is_active = TRUE""",
)
def q_plant_card_flags(spark, sf_dir):
    return A.plant_card_flags(T(spark, sf_dir), MEASURE_AS_OF)


@register(
    "height_trends",
    f"""
WITH m AS (SELECT * FROM measurements WHERE height_cm IS NOT NULL),
r AS (SELECT plant_id, height_cm, row_number() OVER (PARTITION BY plant_id ORDER BY {M_ASC}) AS ra,
             row_number() OVER (PARTITION BY plant_id ORDER BY {M_DESC}) AS rd,
             count(*) OVER (PARTITION BY plant_id) AS n FROM m),
w AS (SELECT plant_id, height_cm, row_number() OVER (PARTITION BY plant_id ORDER BY measurement_date, id) AS ra,
             row_number() OVER (PARTITION BY plant_id ORDER BY measurement_date DESC, id DESC) AS rd,
             count(*) OVER (PARTITION BY plant_id) AS wn
      FROM m WHERE measurement_date >= {MS} - INTERVAL 30 DAY)
SELECT p.id AS plant_id,
       CASE WHEN COALESCE(wf.wn, 0) < 2 THEN 'INSUFFICIENT' WHEN wl.height_cm > wf.height_cm THEN 'UP'
            WHEN wl.height_cm < wf.height_cm THEN 'DOWN' ELSE 'STABLE' END AS growth_trend,
       CASE WHEN f.n >= 2 THEN l.height_cm - f.height_cm END AS total_growth
FROM plants p
LEFT JOIN (SELECT * FROM r WHERE ra = 1) f ON f.plant_id = p.id
LEFT JOIN (SELECT * FROM r WHERE rd = 1) l ON l.plant_id = p.id
LEFT JOIN (SELECT * FROM w WHERE ra = 1) wf ON wf.plant_id = p.id
LEFT JOIN (SELECT * FROM w WHERE rd = 1) wl ON wl.plant_id = p.id""",
)
def q_height_trends(spark, sf_dir):
    return A.height_trends(T(spark, sf_dir), MEASURE_AS_OF)


@register(
    "latest_measurement",
    f"""
WITH lm AS ({latest_m()})
SELECT p.id AS plant_id, lm.id AS measurement_id, lm.measurement_date,
       CASE WHEN lm.height_cm <> 0 THEN lm.height_cm END AS current_height,
       lm.health_status AS current_health_status,
       CASE WHEN lm.plant_id IS NULL THEN 'NO_MEASUREMENT' ELSE {HEALTH_APP.format(h='lm.health_status')} END
         AS current_health_text
FROM plants p LEFT JOIN lm ON lm.plant_id = p.id""",
)
def q_latest_measurement(spark, sf_dir):
    return A.latest_measurement(T(spark, sf_dir))


@register(
    "dashboard_metrics",
    f"""
WITH {DUE_CTE},
attention AS ({NEEDS_ATTENTION_SQL})
SELECT * FROM (SELECT count(*) FILTER (is_active) AS total_plants FROM plants),
              (SELECT count(*) AS total_events FROM care_events),
              (SELECT count(*) AS upcoming_reminders FROM due SEMI JOIN owners USING (plant_id) SEMI JOIN kinds USING (event_type_id)),
              (SELECT count(*) AS plants_needing_attention FROM attention)""",
)
def q_dashboard_metrics(spark, sf_dir):
    return A.dashboard_metrics(T(spark, sf_dir), EVENTS_AS_OF)


@register(
    "recent_events",
    """
SELECT e.id, e.plant_id, p.name AS plant_name, et.name AS event_type_name, e.event_date, e.description, e.created_at
FROM care_events e JOIN plants p ON e.plant_id = p.id JOIN event_types et ON e.event_type_id = et.id
WHERE p.is_active = TRUE ORDER BY e.created_at DESC NULLS FIRST, e.id DESC LIMIT 5""",
)
def q_recent_events(spark, sf_dir):
    return A.recent_events(T(spark, sf_dir), 5)


@register(
    "recent_images",
    """
SELECT i.id, i.plant_id, p.name AS plant_name, i.filename, i.upload_date, i.file_size
FROM plant_images i JOIN plants p ON i.plant_id = p.id
WHERE p.is_active = TRUE ORDER BY i.upload_date DESC NULLS FIRST, i.id DESC LIMIT 6""",
)
def q_recent_images(spark, sf_dir):
    return A.recent_images(T(spark, sf_dir), 6)


AGE_TEXT = """CASE WHEN {d} < 30 THEN CAST({d} AS VARCHAR) || ' days'
            WHEN {d} < 365 THEN CAST({d} // 30 AS VARCHAR) || ' months'
            WHEN ({d} % 365) // 30 > 0
              THEN CAST({d} // 365 AS VARCHAR) || ' years, ' || CAST(({d} % 365) // 30 AS VARCHAR) || ' months'
            ELSE CAST({d} // 365 AS VARCHAR) || ' years' END"""


def _plant_cards_sql(page_no: int, search: str, type_id: int) -> str:
    cond = "is_active = TRUE"
    if search:
        cond += f" AND name LIKE '%{search}%'"
    if type_id > 0:
        cond += f" AND plant_type_id = {type_id}"
    return f"""
WITH pg AS (SELECT * FROM plants WHERE {cond} ORDER BY created_at DESC NULLS FIRST, id DESC
            LIMIT 12 OFFSET {(max(page_no, 1) - 1) * 12}),
ev AS (SELECT plant_id, count(*) AS c FROM care_events GROUP BY plant_id),
im AS (SELECT plant_id, count(*) AS c,
              min(CASE WHEN r = 1 THEN filename END) AS first_image
       FROM (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY upload_date IS NULL, upload_date, id) AS r
             FROM plant_images) x GROUP BY plant_id),
ms AS (SELECT plant_id, count(*) AS c, min(CASE WHEN r = 1 THEN health_status END) AS latest_health
       FROM (SELECT *, row_number() OVER (PARTITION BY plant_id ORDER BY {M_DESC}) AS r FROM measurements) x
       GROUP BY plant_id)
SELECT pg.id, pg.name, pg.plant_type_id, pt.name AS plant_type, pt.scientific_name,
       strftime(pg.planted_date, '%d.%m.%Y') AS planted_text, {AGE_TEXT.format(d=cd(MS, 'pg.planted_date'))} AS age_text,
       pg.location, pg.created_at, COALESCE(ev.c, 0) AS event_count,
       COALESCE(im.c, 0) AS image_count, COALESCE(ms.c, 0) AS measurement_count, ms.latest_health,
       CASE WHEN ms.latest_health IS NOT NULL THEN {HEALTH_APP.format(h='ms.latest_health')} END AS latest_health_text,
       im.first_image
FROM pg LEFT JOIN ev ON ev.plant_id = pg.id LEFT JOIN im ON im.plant_id = pg.id LEFT JOIN ms ON ms.plant_id = pg.id
LEFT JOIN plant_types pt ON pt.id = pg.plant_type_id"""


@register("plant_cards", _plant_cards_sql(1, "", 0))
def q_plant_cards(spark, sf_dir):
    return A.plant_cards(T(spark, sf_dir), 1, as_of=MEASURE_AS_OF)


@register("plant_cards_search", _plant_cards_sql(2, "Customer#0000001", 0))
def q_plant_cards_search(spark, sf_dir):
    return A.plant_cards(T(spark, sf_dir), 2, search="Customer#0000001", as_of=MEASURE_AS_OF)


@register(
    "plant_detail_events",
    """
SELECT * FROM (SELECT id, plant_id, event_type_id, event_date, description, is_completed,
                      CAST(row_number() OVER (PARTITION BY plant_id ORDER BY event_date DESC, id DESC) AS INTEGER)
                        AS rank
               FROM care_events) x WHERE rank <= 10""",
)
def q_plant_detail_events(spark, sf_dir):
    return A.detail_events(T(spark, sf_dir), 10)


@register(
    "plant_detail_measurements",
    f"""
SELECT * FROM (SELECT id, plant_id, measurement_date, height_cm, leaf_count, health_status,
                      CAST(row_number() OVER (PARTITION BY plant_id ORDER BY {M_DESC}) AS INTEGER) AS rank
               FROM measurements) x WHERE rank <= 5""",
)
def q_plant_detail_measurements(spark, sf_dir):
    return A.detail_measurements(T(spark, sf_dir), 5)


@register(
    "plant_detail_reminders",
    """
SELECT id, plant_id, event_type_id, reminder_date, message, is_sent FROM reminders WHERE is_completed = FALSE""",
)
def q_plant_detail_reminders(spark, sf_dir):
    return A.detail_reminders(T(spark, sf_dir))


def _event_list_sql(page_no: int, plant_id: int, type_id: int) -> str:
    cond = "p.is_active = TRUE"
    if plant_id > 0:
        cond += f" AND e.plant_id = {plant_id}"
    if type_id > 0:
        cond += f" AND e.event_type_id = {type_id}"
    d = cd("pg.event_date", EV)
    return f"""
WITH pg AS (SELECT e.*, p.name AS plant_name FROM care_events e JOIN plants p ON e.plant_id = p.id
            WHERE {cond} ORDER BY e.event_date DESC, e.id DESC LIMIT 20 OFFSET {(max(page_no, 1) - 1) * 20})
SELECT pg.id, pg.plant_id, pg.plant_name, pg.event_type_id, pg.event_date,
       {trunc_sql('pg.description', 50)} AS description_short, {trunc_sql('pg.notes', 30)} AS notes_short,
       pg.is_completed, {d} AS days_until, {due_sql(d)} AS due_label,
       CASE WHEN pg.is_completed THEN 'DONE' WHEN pg.event_date < {EV} THEN 'OVERDUE' WHEN {d} <= 1 THEN 'URGENT'
            ELSE 'PLANNED' END AS status
FROM pg"""


@register("event_list", _event_list_sql(1, 0, 0))
def q_event_list(spark, sf_dir):
    return A.event_list(T(spark, sf_dir), EVENTS_AS_OF, 1)


@register("event_list_filtered", _event_list_sql(2, 0, 1))
def q_event_list_filtered(spark, sf_dir):
    return A.event_list(T(spark, sf_dir), EVENTS_AS_OF, 2, event_type_id=1)


@register(
    "measurement_list",
    f"""
WITH pg AS (SELECT m.*, p.name AS plant_name FROM measurements m JOIN plants p ON m.plant_id = p.id
            WHERE p.is_active = TRUE ORDER BY m.measurement_date DESC NULLS FIRST, m.id DESC LIMIT 20)
SELECT id, plant_id, plant_name, measurement_date, height_cm, leaf_count, health_status,
       {HEALTH_APP.format(h='health_status')} AS health_text, {trunc_sql('notes', 50)} AS notes_short
FROM pg""",
)
def q_measurement_list(spark, sf_dir):
    return A.measurement_list(T(spark, sf_dir), 1)


@register(
    "image_list",
    """
SELECT i.id, i.plant_id, p.name AS plant_name, i.filename, i.upload_date, i.file_size,
       round(i.file_size / 1048576.0, 1) AS size_mb
FROM plant_images i JOIN plants p ON i.plant_id = p.id
WHERE p.is_active = TRUE ORDER BY i.upload_date DESC NULLS FIRST, i.id DESC LIMIT 24""",
)
def q_image_list(spark, sf_dir):
    return A.image_list(T(spark, sf_dir), 1)


_BOARD = f"""
SELECT r.id, r.plant_id, p.name AS plant_name, r.event_type_id, r.reminder_date, r.message, r.is_sent,
       {REMINDER_STATUS.format(now=EV)} AS status, {cd('r.reminder_date', EV)} AS days_until,
       {due_sql(cd('r.reminder_date', EV))} AS due_label
FROM reminders r JOIN plants p ON r.plant_id = p.id
WHERE r.is_completed = FALSE AND p.is_active = TRUE"""


@register("reminder_board", _BOARD)
def q_reminder_board(spark, sf_dir):
    return A.reminder_board(T(spark, sf_dir), EVENTS_AS_OF)


@register(
    "reminder_status_counts",
    f"""
WITH b AS ({_BOARD})
SELECT count(*) FILTER (WHERE status = 'OVERDUE') AS overdue, count(*) FILTER (WHERE status = 'URGENT') AS urgent,
       count(*) FILTER (WHERE status = 'SOON') AS soon, count(*) FILTER (WHERE status = 'FUTURE') AS future,
       count(*) AS total
FROM b""",
)
def q_reminder_status_counts(spark, sf_dir):
    return A.reminder_status_counts(T(spark, sf_dir), EVENTS_AS_OF)


@register(
    "event_search",
    """
SELECT id, plant_id, event_type_id, event_date, description, is_completed FROM care_events
WHERE event_date >= TIMESTAMP '1996-01-01 00:00:00' AND event_date < TIMESTAMP '1997-01-01 00:00:00'
  AND description LIKE '%URGENT%'""",
)
def q_event_search(spark, sf_dir):
    return A.event_search(T(spark, sf_dir), "1996-01-01", "1996-12-31", text="URGENT")


_AGE_D = cd(MS, "planted_date")


@register(
    "plant_age_labels",
    f"""
SELECT id, {_AGE_D} AS days_since_planted,
       CASE WHEN {_AGE_D} < 30 THEN CAST({_AGE_D} AS VARCHAR) || ' days'
            WHEN {_AGE_D} < 365 THEN CAST({_AGE_D} // 30 AS VARCHAR) || ' months'
            WHEN ({_AGE_D} % 365) // 30 > 0
              THEN CAST({_AGE_D} // 365 AS VARCHAR) || ' years, ' || CAST(({_AGE_D} % 365) // 30 AS VARCHAR) || ' months'
            ELSE CAST({_AGE_D} // 365 AS VARCHAR) || ' years' END AS age_text,
       strftime(planted_date, '%d.%m.%Y') AS planted_text, strftime(created_at, '%d.%m.%Y %H:%M') AS created_text
FROM plants""",
)
def q_plant_age_labels(spark, sf_dir):
    return A.plant_age_labels(T(spark, sf_dir), MEASURE_AS_OF)


@register(
    "plant_detail_images",
    """
SELECT id, plant_id, filename, upload_date, file_size,
       CAST(row_number() OVER (PARTITION BY plant_id ORDER BY upload_date DESC NULLS FIRST, id DESC) AS INTEGER) AS rank
FROM plant_images""",
)
def q_plant_detail_images(spark, sf_dir):
    return A.detail_images(T(spark, sf_dir))


@register(
    "dashboard_attention",
    "WITH na AS (" + NEEDS_ATTENTION_SQL + """)
SELECT * FROM na
ORDER BY urgency DESC, last_event_date ASC NULLS LAST, plant_id, reason LIMIT 3""",
)
def q_dashboard_attention(spark, sf_dir):
    return A.top_attention(T(spark, sf_dir), EVENTS_AS_OF, 3)


@register(
    "dashboard_upcoming",
    f"""
WITH {DUE_CTE}
SELECT * EXCLUDE (plant_id, event_type_id),
       coalesce((['today', 'tomorrow'])[days_until + 1], format('{{}} days', days_until)) AS badge
FROM due JOIN kinds USING (event_type_id) JOIN owners USING (plant_id)
ORDER BY reminder_date, reminder_id LIMIT 5""",
)
def q_dashboard_upcoming(spark, sf_dir):
    return A.top_upcoming(T(spark, sf_dir), EVENTS_AS_OF, 5)
