"""Declared schemas of the eight care tables (plus the change feed).

Keys are LongType so that the driver's bigint keys fit; measures that the
source keeps as DECIMAL(5,2) are doubles here (value-equal with the SQL oracle).
"""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _s(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


PLANT_TYPES = _s(
    ("id", LongType()),
    ("name", StringType()),
    ("scientific_name", StringType()),
    ("description", StringType()),
    ("care_instructions", StringType()),
    ("watering_frequency_days", IntegerType()),
    ("fertilizing_frequency_days", IntegerType()),
    ("created_at", TimestampNTZType()),
    ("updated_at", TimestampNTZType()),
)

PLANTS = _s(
    ("id", LongType()),
    ("name", StringType()),
    ("plant_type_id", LongType()),
    ("planted_date", DateType()),
    ("location", StringType()),
    ("notes", StringType()),
    ("is_active", BooleanType()),
    ("created_at", TimestampNTZType()),
    ("updated_at", TimestampNTZType()),
    ("valid_from", TimestampNTZType()),
    ("valid_to", TimestampNTZType()),
)

# plants_history: every plants column, then the audit columns; `seq` orders
# changes that share one timestamp.
PLANT_HISTORY = StructType(
    PLANTS.fields
    + [
        StructField("operation_type", StringType(), True),
        StructField("changed_by", StringType(), True),
        StructField("changed_at", TimestampNTZType(), True),
        StructField("seq", LongType(), True),
    ]
)

# Change feed feeding the SCD2 build: the new image of a plant per change.
PLANT_CHANGES = StructType(
    [f for f in PLANTS.fields if f.name not in ("valid_from", "valid_to")]
    + [
        StructField("operation_type", StringType(), True),
        StructField("changed_by", StringType(), True),
        StructField("changed_at", TimestampNTZType(), True),
        StructField("seq", LongType(), True),
    ]
)

EVENT_TYPES = _s(
    ("id", LongType()),
    ("name", StringType()),
    ("description", StringType()),
    ("default_reminder_days", IntegerType()),
    ("color", StringType()),
)

EVENTS = _s(
    ("id", LongType()),
    ("plant_id", LongType()),
    ("event_type_id", LongType()),
    ("event_date", TimestampNTZType()),
    ("description", StringType()),
    ("notes", StringType()),
    ("reminder_date", TimestampNTZType()),
    ("is_completed", BooleanType()),
    ("created_at", TimestampNTZType()),
    ("updated_at", TimestampNTZType()),
)

PLANT_IMAGES = _s(
    ("id", LongType()),
    ("plant_id", LongType()),
    ("filename", StringType()),
    ("original_filename", StringType()),
    ("upload_date", TimestampNTZType()),
    ("description", StringType()),
    ("file_size", LongType()),
    ("mime_type", StringType()),
)

REMINDERS = _s(
    ("id", LongType()),
    ("plant_id", LongType()),
    ("event_type_id", LongType()),
    ("reminder_date", TimestampNTZType()),
    ("message", StringType()),
    ("is_sent", BooleanType()),
    ("is_completed", BooleanType()),
    ("created_at", TimestampNTZType()),
)

MEASUREMENTS = _s(
    ("id", LongType()),
    ("plant_id", LongType()),
    ("measurement_date", TimestampNTZType()),
    ("height_cm", DoubleType()),
    ("width_cm", DoubleType()),
    ("leaf_count", IntegerType()),
    ("flower_count", IntegerType()),
    ("health_status", IntegerType()),
    ("notes", StringType()),
)

TABLES = {
    "plant_types": PLANT_TYPES,
    "plants": PLANTS,
    "event_types": EVENT_TYPES,
    "events": EVENTS,
    "plant_images": PLANT_IMAGES,
    "reminders": REMINDERS,
    "measurements": MEASUREMENTS,
    "plants_history": PLANT_HISTORY,
}
