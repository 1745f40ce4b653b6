"""Hand-made edge rows (FIXTURES.md §4) against the rules of the source."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tendril.functions.days import END_OF_TIME
from tendril.plans import analytics as A
from tendril.plans import rules as R
from tendril.plans import views as V
from tendril.sources import schemas
from tendril.sources.demo import demo_tables
from tendril.sources.tables import CareTables

D = dt.datetime
NOW = "2024-07-01 12:00:00"


@pytest.fixture(scope="module")
def edge(spark):
    demo = demo_tables(spark)
    end = D.fromisoformat(END_OF_TIME)
    plants = [
        (1, "a_plant", 1, dt.date(2024, 1, 1), None, None, True, D(2024, 1, 1), None, D(2024, 1, 1), end),
        (2, "abplant", None, dt.date(2024, 1, 1), None, None, True, D(2024, 1, 1), None, D(2024, 1, 1), end),  # no type
        (3, "nomeasure", 1, dt.date(2024, 1, 1), None, None, True, D(2024, 6, 28), None, D(2024, 1, 1), end),
        (4, "inactive", 1, dt.date(2024, 1, 1), None, None, False, D(2024, 1, 1), None, D(2024, 1, 1), end),
        (5, "nullhealth", 1, dt.date(2024, 1, 1), None, None, True, D(2024, 1, 1), None, D(2024, 1, 1), end),
    ]
    meas = [
        (1, 1, D(2024, 6, 20), None, None, 3, None, 2, None),  # heights all NULL for plant 1
        (2, 1, D(2024, 6, 25), None, None, 4, None, 4, None),
        (3, 2, D(2024, 7, 3), 10.0, None, 1, None, 5, None),  # future-dated
        (4, 5, D(2024, 6, 1), 5.0, None, 1, None, 1, None),
        (5, 5, D(2024, 6, 30), 6.0, None, 1, None, None, None),  # newest health NULL, fresh
    ]
    events = [
        (1, 1, 1, D(2024, 6, 30), None, None, None, True, D(2024, 6, 30), None),
        (2, 2, None, D(2024, 6, 30), None, None, None, False, D(2024, 6, 30), None),  # no type
        (3, 1, 2, D(2024, 6, 10), None, None, None, None, D(2024, 6, 10), None),  # completion NULL
    ]
    reminders = [
        (1, 1, 1, D(2024, 6, 30), "sent, past", True, False, None),
        (2, 1, 1, D(2024, 7, 1, 12), "exactly now", False, False, None),
        (3, 1, 1, D(2024, 7, 8, 12), "exactly now + 7d", False, False, None),
        (4, 1, 1, D(2024, 7, 8, 12, 0, 1), "just after", False, False, None),
        (5, 4, 1, D(2024, 6, 1), "inactive plant, overdue", False, False, None),
    ]
    return CareTables(
        plant_types=demo.plant_types,
        plants=spark.createDataFrame(plants, schemas.PLANTS),
        event_types=demo.event_types,
        events=spark.createDataFrame(events, schemas.EVENTS),
        reminders=spark.createDataFrame(reminders, schemas.REMINDERS),
        measurements=spark.createDataFrame(meas, schemas.MEASUREMENTS),
        plant_images=spark.createDataFrame([], schemas.PLANT_IMAGES),
    )


def test_look_ahead_is_closed_at_both_ends(edge):
    ids = sorted(r.reminder_id for r in A.upcoming_reminders(edge, NOW, 7).collect())
    assert ids == [2, 3]


def test_past_and_sent_reminder_is_urgent_and_inactive_plants_differ(edge):
    v5 = {r.id: r.reminder_status for r in V.active_reminders(edge, NOW).collect()}
    assert v5[1] == "URGENT" and v5[5] == "OVERDUE"  # the view keeps inactive plants
    board = {r.id for r in A.reminder_board(edge, NOW).collect()}
    assert 5 not in board and 1 in board  # the board does not


def test_like_search_treats_underscore_as_wildcard(edge):
    names = {r.name for r in A.plant_cards(edge, 1, search="a_p").collect()}
    assert names == {"a_plant", "abplant"}


def test_all_heights_null(edge):
    trends = {r.plant_id: (r.growth_trend, r.total_growth) for r in A.height_trends(edge, NOW).collect()}
    assert trends[1] == ("INSUFFICIENT", None)
    stats = {r.plant_id: r for r in V.growth_statistics(edge, NOW).collect()}
    assert stats[1].total_growth == 0.0 and stats[1].growth_trend_30days == "STABLE"  # 2 rows, NULL compare


def test_event_without_type(edge):
    assert 2 not in {r.id for r in V.events_detailed(edge, NOW).collect()}
    assert 2 not in {r.source_event_id for r in R.event_reminders(edge.events, edge, NOW).collect()}


def test_completion_null_to_true_does_not_fire(edge):
    old = edge.events
    new = edge.events.withColumn("is_completed", F.lit(True))
    fired = {r.source_event_id for r in R.next_events(old, new, edge, NOW).collect()}
    assert fired == set()  # event 1 was already TRUE, event 3 was NULL, event 2 has no type


def test_future_measurement_and_alert_rules(edge):
    ov = {r.id: r.days_ago for r in V.measurements_overview(edge, NOW).collect()}
    assert ov[3] == -1  # future-dated: negative whole days
    alerts = {r.plant_id: r.alert_level for r in V.health_alerts(edge, NOW).collect()}
    assert alerts[3] == "OK"  # no measurement: listed, level OK
    assert 5 not in alerts  # newest health NULL and fresh: not listed
    ha = {r.plant_id: r.needs_attention for r in A.health_analysis(edge, NOW).collect()}
    assert ha[3] is False
    flags = {r.plant_id: (r.needs_attention, r.reason) for r in A.plant_card_flags(edge, NOW).collect()}
    assert flags[3] == (True, "No measurements")
    att = A.needs_attention(edge, NOW).collect()
    # plant 5: newest non-NULL health is 1 -> health branch, urgency 3
    assert any(r.plant_id == 5 and r.urgency == 3 and r.reason == "Poor health - 1/5" for r in att)
    # plant 3 never watered: created 2024-06-28 -> 3 days, not listed
    assert not any(r.plant_id == 3 for r in att)


def test_status_counts_add_up(spark):
    from tests.conftest import SF001
    from tendril.sources.roles import EVENTS_AS_OF, role_tables

    t = role_tables(spark, SF001)
    c = A.reminder_status_counts(t, EVENTS_AS_OF).first()
    assert c.overdue + c.urgent + c.soon + c.future == c.total == A.reminder_board(t, EVENTS_AS_OF).count()
