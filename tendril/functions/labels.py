"""Label rules as `when` chains (C-1, C-3 .. C-5, D-3, D-8, X-2).

The source prints Croatian words; this build emits neutral English codes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes that replace the source's labels, in the source's order.
HEALTH_TEXT = {1: "VERY_POOR", 2: "POOR", 3: "FAIR", 4: "GOOD", 5: "EXCELLENT"}
HEALTH_UNKNOWN = "UNKNOWN"
HEALTH_NOT_MEASURED = "NOT_MEASURED"
NO_MEASUREMENT = "NO_MEASUREMENT"
TREND_UP, TREND_DOWN, TREND_FLAT = "UP", "DOWN", "FLAT"
TREND_STABLE, TREND_INSUFFICIENT = "STABLE", "INSUFFICIENT"
REMINDER_DONE, REMINDER_OVERDUE = "DONE", "OVERDUE"
REMINDER_URGENT, REMINDER_SOON, REMINDER_FUTURE = "URGENT", "SOON", "FUTURE"
EVENT_DONE, EVENT_OVERDUE, EVENT_URGENT, EVENT_PLANNED = "DONE", "OVERDUE", "URGENT", "PLANNED"
ALERT_CRITICAL, ALERT_BAD, ALERT_WARNING, ALERT_STALE, ALERT_OK = "CRITICAL", "BAD", "WARNING", "STALE", "OK"
ALERT_MESSAGES = {
    "bad": "Plant needs urgent attention - health is poor",
    "stress": "Plant shows signs of stress - check conditions",
    "stale": "No new measurements for a long time - check recommended",
    "ok": "Plant is in good condition",
}
OPERATION_LABELS = {"INSERT": "CREATED", "UPDATE": "UPDATED", "DELETE": "DELETED"}
URGENCY_LABELS = {3: "HIGH", 2: "MEDIUM", 1: "LOW"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def health_text_sql(health) -> Column:
    """SQL rule: 1..5 to a code, anything else (NULL too) UNKNOWN."""
    h = _col(health)
    out = F.when(h == 1, HEALTH_TEXT[1])
    for k in (2, 3, 4, 5):
        out = out.when(h == k, HEALTH_TEXT[k])
    return out.otherwise(HEALTH_UNKNOWN)


def health_text_app(health) -> Column:
    """Application rule: NULL or 0 -> NOT_MEASURED, 1..5 -> code, else UNKNOWN."""
    h = _col(health)
    return F.when(h.isNull() | (h == 0), HEALTH_NOT_MEASURED).otherwise(health_text_sql(h))


def compare_label(current, previous, up: str, down: str, flat: str) -> Column:
    """up if current > previous, down if <, else flat (NULL compares fall to flat)."""
    c, p = _col(current), _col(previous)
    return F.when(c > p, up).when(c < p, down).otherwise(flat)


def reminder_status(reminder_date, is_sent, is_completed, as_of: Column) -> Column:
    """DONE / OVERDUE (past, not sent) / URGENT (<= 1 day) / SOON (<= 3 days) / FUTURE.

    The order matters: a past reminder that *was* sent is URGENT.
    """
    d = _col(reminder_date)
    return (
        F.when(_col(is_completed), REMINDER_DONE)
        .when((d < as_of) & ~_col(is_sent), REMINDER_OVERDUE)
        .when(d <= as_of + F.make_dt_interval(days=F.lit(1)), REMINDER_URGENT)
        .when(d <= as_of + F.make_dt_interval(days=F.lit(3)), REMINDER_SOON)
        .otherwise(REMINDER_FUTURE)
    )


def event_status(event_date, is_completed, days_until, as_of: Column) -> Column:
    """Event badge: DONE / OVERDUE (the event time has passed, compared as
    timestamps) / URGENT (<= 1 calendar day ahead) / PLANNED."""
    return (
        F.when(_col(is_completed), EVENT_DONE)
        .when(_col(event_date) < as_of, EVENT_OVERDUE)
        .when(_col(days_until) <= 1, EVENT_URGENT)
        .otherwise(EVENT_PLANNED)
    )


def due_label(days) -> Column:
    """D-8: 'n days late' / 'today' / 'tomorrow' / 'in n days'."""
    d = _col(days)
    return (
        F.when(d < 0, F.concat(F.abs(d).cast("string"), F.lit(" days late")))
        .when(d == 0, F.lit("today"))
        .when(d == 1, F.lit("tomorrow"))
        .otherwise(F.concat(F.lit("in "), d.cast("string"), F.lit(" days")))
    )


def due_badge(days) -> Column:
    """D-8, dashboard variant: <= 0 -> 'today', 1 -> 'tomorrow', else 'n days'."""
    d = _col(days)
    return (
        F.when(d <= 0, F.lit("today"))
        .when(d == 1, F.lit("tomorrow"))
        .otherwise(F.concat(d.cast("string"), F.lit(" days")))
    )


def age_text(days) -> Column:
    """D-3: < 30 days -> days; < 365 -> months (days // 30); else years [+ months]."""
    d = _col(days)
    years = F.floor(d / 365).cast("int")
    rest_months = F.floor((d % 365) / 30).cast("int")
    return (
        F.when(d < 30, F.concat(d.cast("string"), F.lit(" days")))
        .when(d < 365, F.concat(F.floor(d / 30).cast("string"), F.lit(" months")))
        .when(
            rest_months > 0,
            F.concat(years.cast("string"), F.lit(" years, "), rest_months.cast("string"), F.lit(" months")),
        )
        .otherwise(F.concat(years.cast("string"), F.lit(" years")))
    )


def operation_label(op) -> Column:
    o = _col(op)
    out = F.when(o == "INSERT", OPERATION_LABELS["INSERT"])
    out = out.when(o == "UPDATE", OPERATION_LABELS["UPDATE"]).when(o == "DELETE", OPERATION_LABELS["DELETE"])
    return out.otherwise(o)


def urgency_label(u) -> Column:
    x = _col(u)
    return F.when(x == 3, URGENCY_LABELS[3]).when(x == 2, URGENCY_LABELS[2]).otherwise(URGENCY_LABELS[1])


def truncate_text(text, n: int) -> Column:
    """X-2: longer than n characters -> first n + '...'."""
    t = _col(text)
    return F.when(F.char_length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def round_ratio(num, den, digits: int) -> Column:
    """ROUND(num / den, digits), half away from zero, for integer num, den > 0.

    Done in integer arithmetic so that the result is bit-identical to any
    other engine computing the same decimal value (no binary-float ties).
    """
    scale = 10**digits
    n, d = _col(num).cast("long"), _col(den).cast("long")
    mag = F.floor((F.abs(n) * F.lit(2 * scale) + d) / (d * 2))
    return F.when(d > 0, F.signum(n) * mag.cast("double") / F.lit(float(scale)))


def round_half_up(x, digits: int) -> Column:
    """ROUND for a non-negative double that is not a ratio of integers (e.g. a
    mean of means): ``floor(x * 10^d + 0.5) / 10^d``.  Written out so that any
    engine evaluating the same IEEE operations gets the same bits."""
    scale = float(10**digits)
    return F.floor(_col(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


# The source's display texts for the codes above, in the
# source's order (growth trend, reminder status, alert level, health text,
# health trend).
SOURCE_LABELS = {
    "UP": "Raste",
    "DOWN": "Opada",
    "FLAT": "Stagnira",
    "STABLE": "Stabilno",
    "INSUFFICIENT": "Nedovoljno podataka",
    "DONE": "Završeno",
    "OVERDUE": "Zakasnilo",
    "URGENT": "Hitno",
    "SOON": "Uskoro",
    "FUTURE": "Budućnost",
    "CRITICAL": "KRITIČNO",
    "BAD": "LOŠE",
    "WARNING": "UPOZORENJE",
    "STALE": "ZASTARJELI PODACI",
    "OK": "OK",
    "VERY_POOR": "Vrlo loše",
    "POOR": "Loše",
    "FAIR": "Osrednje",
    "GOOD": "Dobro",
    "EXCELLENT": "Izvrsno",
    "UNKNOWN": "Nepoznato",
    "NOT_MEASURED": "Nije izmjereno",
    "IMPROVING": "Poboljšava se",
    "WORSENING": "Pogoršava se",
}


def source_label(code, labels: dict[str, str] | None = None) -> Column:
    """The display text of a code (a literal map lookup, no join); codes
    without an entry pass through unchanged."""
    pairs = []
    for k, v in (labels or SOURCE_LABELS).items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(code)), _col(code))
