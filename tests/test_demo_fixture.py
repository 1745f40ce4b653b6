"""Demo rows with fixed as-of times against the expected values of FIXTURES.md."""

import datetime as dt

from pyspark.sql import functions as F

from tendril.plans import analytics as A
from tendril.plans import rules as R
from tendril.plans import views as V


def by_id(rows, key):
    return {r[key]: r for r in rows}


def test_growth_stats(demo):
    rows = by_id(A.growth_stats(demo).collect(), "plant_id")
    exp = {
        1: (6, "2024-01-20", "2024-06-15", 37.5, 12.5, 20, 4, 4.33),
        2: (6, "2023-09-01", "2024-06-10", 65.0, 20.0, 14, 4, 4.17),
        3: (4, "2024-03-15", "2024-06-18", 40.0, 25.0, 32, 4, 4.5),
    }
    for pid, (n, first, last, cur_h, growth, leaves, health, avg) in exp.items():
        r = rows[pid]
        assert r.total_measurements == n
        assert r.first_measurement_date.date().isoformat() == first
        assert r.last_measurement_date.date().isoformat() == last
        assert r.current_height_cm == cur_h == r.max_height_cm
        assert r.height_growth_cm == growth
        assert r.current_leaf_count == leaves
        assert r.current_health_status == health
        assert r.avg_health_status == avg


def test_growth_statistics_period_and_trend(demo):
    rows = by_id(V.growth_statistics(demo, "2024-06-18 12:00:00").collect(), "plant_id")
    assert {p: r.measurement_period_days for p, r in rows.items()} == {1: 147, 2: 283, 3: 95}
    assert rows[1].growth_trend_30days == "UP"
    assert rows[2].growth_trend_30days == "INSUFFICIENT"
    assert rows[3].growth_trend_30days == "INSUFFICIENT"
    later = V.growth_statistics(demo, "2024-07-01 00:00:00").collect()
    assert {r.growth_trend_30days for r in later} == {"INSUFFICIENT"}


def test_needs_attention(demo):
    rows = A.needs_attention(demo, "2024-07-01 00:00:00").orderBy(*A.needs_attention_order()).collect()
    got = [(r.plant_id, r.urgency, r.reason) for r in rows]
    assert got == [
        (2, 3, "Not watered for 19 days"),
        (1, 2, "Not watered for 11 days"),
        (3, 2, "Not watered for 11 days"),
    ]


def test_active_reminders_status(demo):
    rows = V.active_reminders(demo, "2024-07-01 12:00:00").collect()
    got = {r.id: (r.reminder_status, r.days_until_reminder) for r in rows}
    assert got == {
        3: ("OVERDUE", -6),
        5: ("OVERDUE", -5),
        1: ("OVERDUE", -4),
        6: ("OVERDUE", -3),
        9: ("OVERDUE", 0),
        7: ("FUTURE", 3),
        4: ("FUTURE", 8),
        2: ("FUTURE", 13),
        8: ("FUTURE", 18),
    }


def test_upcoming_reminders(demo):
    rows = A.upcoming_reminders(demo, "2024-06-25 12:00:00", 7).orderBy("reminder_date").collect()
    assert [(r.reminder_id, r.days_until) for r in rows] == [(5, 0), (1, 1), (6, 2), (9, 5)]


def test_plant_type_stats(demo):
    rows = by_id(V.plant_type_stats(demo, "2024-07-01 00:00:00").collect(), "name")
    assert (rows["Ficus"].total_plants, rows["Ficus"].avg_age_days) == (1, 168)
    assert (rows["Ficus"].avg_events_per_plant, rows["Ficus"].avg_health_status) == (8.0, 4.33)
    assert (rows["Monstera"].avg_age_days, rows["Monstera"].avg_events_per_plant) == (316, 11.0)
    assert rows["Monstera"].avg_health_status == 4.17
    assert (rows["Pothos"].avg_age_days, rows["Pothos"].avg_health_status) == (113, 4.5)
    for other in ("Sansevieria", "Aloe Vera"):
        r = rows[other]
        assert (r.total_plants, r.avg_age_days, r.avg_events_per_plant, r.avg_health_status) == (0, None, None, None)


def test_plants_overview_last_event(demo):
    rows = by_id(V.plants_overview(demo, "2024-07-01 00:00:00").collect(), "id")
    got = {p: (r.last_event_date.date().isoformat(), r.last_event_type, r.total_events) for p, r in rows.items()}
    assert got == {1: ("2024-06-27", "WATER", 8), 2: ("2024-06-25", "WATER", 11), 3: ("2024-06-26", "WATER", 9)}


def test_calendar_rows(demo):
    assert V.calendar(demo).count() == 37


def test_growth_timeline(demo):
    rows = V.growth_timeline(demo).orderBy("plant_id", "measurement_date").collect()
    got = {}
    for r in rows:
        got.setdefault(r.plant_id, []).append((r.height_growth, r.days_since_last_measurement))
    assert got[1] == [(None, None), (2.5, 31), (2.5, 29), (2.5, 31), (2.5, 30), (2.5, 26)]
    assert got[2] == [(None, None), (3.0, 30), (4.0, 61), (3.0, 62), (5.0, 60), (5.0, 70)]
    assert got[3] == [(None, None), (5.0, 31), (10.0, 30), (10.0, 34)]
    assert {r.growth_trend for r in rows if r.height_growth is None} == {"FLAT"}


def test_event_reminders_count(demo):
    out = R.event_reminders(demo.events, demo, "2024-07-01 00:00:00")
    assert out.count() == 28
    r = out.where(F.col("source_event_id") == 1).first()
    assert r.reminder_date == dt.datetime(2024, 1, 15)
    assert r.message == "Reminder: WATER for plant Moj Ficus"
