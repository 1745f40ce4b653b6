"""SRC-2: the source's demo rows as a table bundle (tests and examples only).

Texts (descriptions, notes, messages) are left out; ids count from 1 in the
order given; plants were created on their planting day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from tendril.functions.days import END_OF_TIME
from tendril.operators.dims import Dim
from tendril.sources import schemas
from tendril.sources.tables import CareTables

# Demo event types (name, default reminder days, colour).
DEMO_EVENT_TYPES = [
    ("WATER", 1, "#007bff"),
    ("FERTILIZE", 3, "#28a745"),
    ("REPOT", 7, "#ffc107"),
    ("PRUNE", 2, "#dc3545"),
    ("SPRAY", 1, "#6f42c1"),
    ("MEASURE", 0, "#20c997"),
]

# Demo plant types (name, scientific name, watering, fertilizing days).
DEMO_PLANT_TYPES = [
    ("Ficus", "Ficus benjamina", 7, 30),
    ("Monstera", "Monstera deliciosa", 10, 21),
    ("Pothos", "Epipremnum aureum", 7, 30),
    ("Sansevieria", "Sansevieria trifasciata", 14, 60),
    ("Aloe Vera", "Aloe barbadensis", 17, 90),
]

# Demo plants (name, type, planted).
DEMO_PLANTS = [
    ("Moj Ficus", 1, "2024-01-15"),
    ("Velika Monstera", 2, "2023-08-20"),
    ("Pothos na zidu", 3, "2024-03-10"),
]

# Demo measurements (plant, date, height, width, leaves, health).
DEMO_MEASUREMENTS = [
    (1, "2024-01-20", 25.0, 20.0, 8, 4),
    (1, "2024-02-20", 27.5, 22.0, 10, 4),
    (1, "2024-03-20", 30.0, 25.0, 12, 5),
    (1, "2024-04-20", 32.5, 27.0, 15, 4),
    (1, "2024-05-20", 35.0, 30.0, 18, 5),
    (1, "2024-06-15", 37.5, 32.0, 20, 4),
    (2, "2023-09-01", 45.0, 35.0, 6, 3),
    (2, "2023-10-01", 48.0, 38.0, 7, 4),
    (2, "2023-12-01", 52.0, 42.0, 8, 5),
    (2, "2024-02-01", 55.0, 45.0, 9, 4),
    (2, "2024-04-01", 60.0, 50.0, 12, 5),
    (2, "2024-06-10", 65.0, 55.0, 14, 4),
    (3, "2024-03-15", 15.0, 25.0, 12, 4),
    (3, "2024-04-15", 20.0, 35.0, 18, 5),
    (3, "2024-05-15", 30.0, 45.0, 25, 5),
    (3, "2024-06-18", 40.0, 60.0, 32, 4),
]

# Demo events (plant, type, date, completed).
DEMO_EVENTS = [
    (1, 1, "2024-01-16", True), (1, 1, "2024-01-23", True), (1, 1, "2024-01-30", True),
    (1, 2, "2024-02-15", True), (1, 1, "2024-02-21", True), (1, 3, "2024-05-18", True),
    (1, 1, "2024-06-20", True), (1, 1, "2024-06-27", False),
    (2, 1, "2023-08-22", True), (2, 1, "2023-09-01", True), (2, 2, "2023-09-10", True),
    (2, 1, "2023-09-15", True), (2, 4, "2023-12-05", True), (2, 1, "2024-02-05", True),
    (2, 2, "2024-02-15", True), (2, 1, "2024-04-03", True), (2, 5, "2024-04-20", True),
    (2, 1, "2024-06-12", True), (2, 1, "2024-06-25", False),
    (3, 1, "2024-03-12", True), (3, 1, "2024-03-19", True), (3, 2, "2024-04-01", True),
    (3, 1, "2024-04-17", True), (3, 1, "2024-05-01", True), (3, 1, "2024-05-17", True),
    (3, 2, "2024-06-01", True), (3, 1, "2024-06-20", True), (3, 1, "2024-06-26", False),
]

# Demo reminders (plant, type, date); none sent or completed.
DEMO_REMINDERS = [
    (1, 1, "2024-06-27 09:00:00"),
    (1, 2, "2024-07-15 10:00:00"),
    (2, 1, "2024-06-25 09:00:00"),
    (2, 3, "2024-07-10 10:00:00"),
    (3, 1, "2024-06-26 09:00:00"),
    (3, 4, "2024-06-28 10:00:00"),
    (1, 4, "2024-07-05 10:00:00"),
    (2, 5, "2024-07-20 10:00:00"),
    (3, 2, "2024-07-01 10:00:00"),
]


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s if " " in s else s + " 00:00:00")


def demo_tables(spark: SparkSession) -> CareTables:
    end = ts(END_OF_TIME)
    etypes = [(i + 1, n, None, d, c) for i, (n, d, c) in enumerate(DEMO_EVENT_TYPES)]
    ptypes = [(i + 1, n, s, None, None, w, f, None, None) for i, (n, s, w, f) in enumerate(DEMO_PLANT_TYPES)]
    plants = [
        (i + 1, n, t, dt.date.fromisoformat(d), None, None, True, ts(d), ts(d), ts(d), end)
        for i, (n, t, d) in enumerate(DEMO_PLANTS)
    ]
    meas = [(i + 1, p, ts(d), h, w, lc, None, hs, None) for i, (p, d, h, w, lc, hs) in enumerate(DEMO_MEASUREMENTS)]
    events = [(i + 1, p, t, ts(d), None, None, None, c, ts(d), ts(d)) for i, (p, t, d, c) in enumerate(DEMO_EVENTS)]
    rem = [(i + 1, p, t, ts(d), f"reminder {i + 1}", False, False, None) for i, (p, t, d) in enumerate(DEMO_REMINDERS)]
    t = CareTables(
        plant_types=spark.createDataFrame(ptypes, schemas.PLANT_TYPES),
        plants=spark.createDataFrame(plants, schemas.PLANTS),
        event_types=spark.createDataFrame(etypes, schemas.EVENT_TYPES),
        events=spark.createDataFrame(events, schemas.EVENTS),
        reminders=spark.createDataFrame(rem, schemas.REMINDERS),
        measurements=spark.createDataFrame(meas, schemas.MEASUREMENTS),
        plant_images=spark.createDataFrame([], schemas.PLANT_IMAGES),
        plants_history=spark.createDataFrame([], schemas.PLANT_HISTORY),
    )
    t._dims["event_types"] = Dim(t.event_types, small=True)
    t._dims["plant_types"] = Dim(t.plant_types, small=True)
    return t
