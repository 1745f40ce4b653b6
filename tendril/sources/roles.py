"""Role views: the care tables expressed over the driver's test tables.

Every role is a projection of whole driver tables (no id subsets, no caps),
written once with the DataFrame API (``role_tables``) and once as SQL text
(``ROLE_CTES``) for the independent DuckDB oracle.

| role          | from                                                       |
| ------------- | ---------------------------------------------------------- |
| plant_types   | nation JOIN region                                         |
| event_types   | five literal rows keyed by the first digit of o_orderpriority |
| plants        | customer                                                   |
| care_events   | orders                                                     |
| reminders     | orders whose status is not 'F'                             |
| measurements  | events (every row)                                         |
| plant_images  | documents (metadata columns only; the text is pruned)       |
| plant_changes | orders JOIN customer, one change per order                 |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.functions.days import END_OF_TIME, add_days, add_hours, as_ts
from tendril.operators.dims import Dim
from tendril.sources import schemas
from tendril.sources.tables import CareTables

# Fixed "as of" times of the roles: care events and reminders live in the
# orders' years, measurements in the events' month.
EVENTS_AS_OF = "2001-06-01 00:00:00"
MEASURE_AS_OF = "2024-02-15 00:00:00"
CHANGES_AS_OF = "1998-01-01 00:00:00"

# Event types of the roles (id, name, description = the
# o_orderpriority it stands for, default reminder days, colour).
EVENT_TYPE_ROWS = [
    (1, "WATER", "1-URGENT", 1, "#1e88e5"),
    (2, "FERTILIZE", "2-HIGH", 3, "#43a047"),
    (3, "REPOT", "3-MEDIUM", 7, "#8d6e63"),
    (4, "SPRAY", "4-NOT SPECIFIED", 1, "#fb8c00"),
    (5, "MEASURE", "5-LOW", 0, "#8e24aa"),
    (6, "OTHER", "not used", 2, "#000000"),  # one name twice, for the uniqueness check
    (7, "OTHER", "not used", 2, "#ffffff"),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _conform(df: DataFrame, schema) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def plant_types_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    r = _read(spark, sf_dir, "region")
    df = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("id"),
        F.when(F.col("n_nationkey") == 24, F.lit(None))
        .when(F.col("n_nationkey").isin(22, 23), F.lit("TWIN"))
        .otherwise(F.col("n_name"))
        .alias("name"),
        F.when(F.col("n_nationkey") == 22, F.repeat("r_name", F.lit(40))).otherwise(F.col("r_name")).alias("scientific_name"),
        F.lit(None).alias("description"),
        F.lit(None).alias("care_instructions"),
        F.when(F.col("n_nationkey") == 21, F.lit(0)).otherwise(F.lit(7) + F.col("n_nationkey") % 11).alias(
            "watering_frequency_days"
        ),
        F.when(F.col("n_nationkey") == 20, F.lit(400)).otherwise(F.lit(21) + F.col("n_nationkey")).alias(
            "fertilizing_frequency_days"
        ),
        F.lit(None).alias("created_at"),
        F.lit(None).alias("updated_at"),
    )
    return _conform(df, schemas.PLANT_TYPES)


def event_types_role(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENT_TYPE_ROWS, schemas.EVENT_TYPES)


def plants_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    created = add_days(as_ts("2001-01-01 00:00:00"), F.col("c_custkey") % 150)
    key = F.col("c_custkey")
    name = (
        F.when(key % 223 == 0, F.lit(None))
        .when(key % 227 == 0, F.repeat("c_name", F.lit(6)))
        .when(key % 229 == 0, F.lit("   "))
        .otherwise(F.col("c_name"))
    )
    df = c.select(
        F.col("c_custkey").alias("id"),
        name.alias("name"),
        F.when(F.col("c_custkey") % 17 == 0, F.lit(None)).otherwise(F.col("c_nationkey")).alias("plant_type_id"),
        F.when(key % 233 != 0, F.date_add(F.lit("2023-01-01").cast("date"), (key % 500).cast("int"))).alias("planted_date"),
        F.when(key % 239 == 0, F.repeat("c_mktsegment", F.lit(15))).otherwise(F.col("c_mktsegment")).alias("location"),
        F.lit(None).alias("notes"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        created.alias("created_at"),
        created.alias("updated_at"),
        created.alias("valid_from"),
        as_ts(END_OF_TIME).alias("valid_to"),
    )
    return _conform(df, schemas.PLANTS)


def _priority_type() -> F.Column:
    return F.substring("o_orderpriority", 1, 1).cast("long")


def care_events_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    created = add_hours(F.col("o_orderdate"), F.col("o_orderkey") % 24)
    df = o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("plant_id"),
        _priority_type().alias("event_type_id"),
        F.col("o_orderdate").alias("event_date"),
        F.when(F.col("o_orderkey") % 5 == 2, F.repeat("o_orderpriority", F.lit(10)))
        .otherwise(F.col("o_orderpriority"))
        .alias("description"),
        F.when(F.col("o_orderkey") % 3 == 0, F.repeat("o_orderpriority", F.lit(4)))
        .when(F.col("o_orderkey") % 3 == 1, F.lit("ok"))
        .alias("notes"),
        F.lit(None).alias("reminder_date"),
        (F.col("o_orderstatus") == "F").alias("is_completed"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )
    return _conform(df, schemas.EVENTS)


def reminders_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "F")
    df = o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("plant_id"),
        _priority_type().alias("event_type_id"),
        add_hours(F.col("o_orderdate"), 9).alias("reminder_date"),
        F.when(F.col("o_orderkey") % 101 != 0, F.col("o_orderpriority")).alias("message"),
        (F.col("o_orderstatus") == "P").alias("is_sent"),
        (F.col("o_orderkey") % 5 == 0).alias("is_completed"),
        F.col("o_orderdate").alias("created_at"),
    )
    return _conform(df, schemas.REMINDERS)


def measurements_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Parse the JSON field once: json_tuple is a generator, so filters on its
    # output are not pushed below it (a projected parse would be inlined into
    # every pushed-down predicate that uses it).
    e = _read(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", F.json_tuple("props", "k").alias("_kstr")
    )
    k, n, u, ts = F.col("_kstr").cast("int"), F.col("event_id"), F.col("user_id"), F.col("ts")
    # some rows without or with an unknown plant; every fiftieth goes to a plant that has few others
    plant = (
        F.when(n % 701 == 0, F.lit(None))
        .when(n % 809 == 0, -n)
        .when(n % 50 == 0, F.lit(200) + F.floor(n / 50) % 1000)
        .otherwise(u)
    )
    # some rows without a date, plants measured long ago, plants with many rows at one instant
    date = (
        F.when(n % 997 == 0, F.lit(None))
        .when(u % 7 == 3, add_days(ts, -60))
        .when(u % 5 == 0, ts.cast("date").cast("timestamp_ntz"))
        .otherwise(ts)
    )
    height = F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value"))
    df = e.select(
        n.alias("id"),
        plant.alias("plant_id"),
        date.alias("measurement_date"),
        F.when(n % 313 == 0, F.col("value") + 1000).otherwise(height).alias("height_cm"),
        F.when(n % 317 == 0, F.lit(-1.0)).otherwise(F.col("value") * 0.8).alias("width_cm"),
        F.when(n % 401 == 0, F.lit(-1)).otherwise(k).alias("leaf_count"),
        F.when(n % 499 == 0, F.lit(10_000)).otherwise(k % 4).alias("flower_count"),
        F.when(n % 601 == 0, F.lit(9)).otherwise(F.nullif(k % 6, F.lit(0))).alias("health_status"),
        F.when(n % 11 == 0, F.repeat("event_type", F.lit(12))).otherwise(F.col("event_type")).alias("notes"),
    )
    return _conform(df, schemas.MEASUREMENTS)


def plant_images_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    n, source = F.col("doc_id"), F.col("source")
    # several images per plant, three uploaded at one time; names of all kinds
    name = (
        F.when(n % 10 == 7, source)
        .when(n % 10 == 8, F.concat(source, F.lit(".tar.gz")))
        .when(n % 10 == 9, F.concat(source, F.lit(".PNG")))
        .otherwise(F.concat(source, F.lit(".jpg")))
    )
    df = d.select(
        n.alias("id"),
        F.when(n % 89 == 0, -1 - n).otherwise(n % 300).alias("plant_id"),
        F.when(n % 97 != 0, source).alias("filename"),
        name.alias("original_filename"),
        add_hours(as_ts("2024-01-01 00:00:00"), F.floor(n / 3)).alias("upload_date"),
        F.col("lang").alias("description"),
        F.col("n_chars").alias("file_size"),
        F.lit("image/jpeg").alias("mime_type"),
    )
    return _conform(df, schemas.PLANT_IMAGES)


def plant_changes_role(spark: SparkSession, sf_dir: str, plants: DataFrame | None = None) -> DataFrame:
    """One change per order: INSERT for a customer's first order, DELETE for
    the last one if its status is 'P', UPDATE otherwise; location = priority."""
    o = _read(spark, sf_dir, "orders")
    plants = plants if plants is not None else plants_role(spark, sf_dir)
    pos = F.struct("o_orderdate", "o_orderkey")
    bounds = o.groupBy("o_custkey").agg(F.min(pos).alias("_first"), F.max(pos).alias("_last"))
    op = (
        F.when(pos == F.col("_first"), F.lit("INSERT"))
        .when((pos == F.col("_last")) & (F.col("o_orderstatus") == "P"), F.lit("DELETE"))
        .otherwise(F.lit("UPDATE"))
    )
    df = (
        o.join(bounds, "o_custkey")
        .join(plants, plants.id == o.o_custkey)
        .select(
            F.col("o_custkey").alias("id"),
            "name",
            "plant_type_id",
            "planted_date",
            F.col("o_orderpriority").alias("location"),
            "notes",
            "is_active",
            "created_at",
            F.col("o_orderdate").alias("updated_at"),
            op.alias("operation_type"),
            F.lit("etl").alias("changed_by"),
            F.col("o_orderdate").alias("changed_at"),
            F.col("o_orderkey").alias("seq"),
        )
    )
    return _conform(df, schemas.PLANT_CHANGES)


_CACHE: dict = {}


def role_tables(spark: SparkSession, sf_dir: str) -> CareTables:
    """All roles over the driver tables of ``sf_dir`` (lazy DataFrames)."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    if key in _CACHE:
        return _CACHE[key]
    plants = plants_role(spark, sf_dir)
    t = CareTables(
        plant_types=plant_types_role(spark, sf_dir),
        plants=plants,
        event_types=event_types_role(spark),
        events=care_events_role(spark, sf_dir),
        reminders=reminders_role(spark, sf_dir),
        measurements=measurements_role(spark, sf_dir),
        plant_images=plant_images_role(spark, sf_dir),
        plant_changes=plant_changes_role(spark, sf_dir, plants),
    )
    # The event type catalog is a literal of five rows: bounded by construction.
    t._dims["event_types"] = Dim(t.event_types, small=True)
    _CACHE[key] = t
    return t


# ---------------------------------------------------------------------------
# The same roles as SQL text (DuckDB dialect) for the oracle.
# ---------------------------------------------------------------------------

_EVENT_TYPES_VALUES = ", ".join(
    f"({i}::BIGINT, '{n}', '{d}', {days}::INTEGER, '{c}')" for i, n, d, days, c in EVENT_TYPE_ROWS
)

ROLE_CTES = {
    "plant_types": """
SELECT CAST(n.n_nationkey AS BIGINT) AS id,
       CASE WHEN n.n_nationkey = 24 THEN NULL WHEN n.n_nationkey IN (22, 23) THEN 'TWIN' ELSE n.n_name END AS name,
       IF(n.n_nationkey = 22, repeat(r.r_name, 40), r.r_name) AS scientific_name,
       CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS care_instructions,
       CAST(IF(n.n_nationkey = 21, 0, 7 + n.n_nationkey % 11) AS INTEGER) AS watering_frequency_days,
       CAST(IF(n.n_nationkey = 20, 400, 21 + n.n_nationkey) AS INTEGER) AS fertilizing_frequency_days,
       CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "event_types": f"""
SELECT * FROM (VALUES {_EVENT_TYPES_VALUES}) AS t(id, name, description, default_reminder_days, color)""",
    "plants": f"""
SELECT c_custkey AS id,
       CASE WHEN c_custkey % 223 = 0 THEN NULL WHEN c_custkey % 227 = 0 THEN repeat(c_name, 6)
            WHEN c_custkey % 229 = 0 THEN '   ' ELSE c_name END AS name,
       CAST(CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_nationkey END AS BIGINT) AS plant_type_id,
       CASE WHEN c_custkey % 233 <> 0 THEN DATE '2023-01-01' + CAST(c_custkey % 500 AS INTEGER) END AS planted_date,
       IF(c_custkey % 239 = 0, repeat(c_mktsegment, 15), c_mktsegment) AS location, CAST(NULL AS VARCHAR) AS notes, c_acctbal >= 0 AS is_active,
       TIMESTAMP '2001-01-01 00:00:00' + to_days(CAST(c_custkey % 150 AS INTEGER)) AS created_at,
       TIMESTAMP '2001-01-01 00:00:00' + to_days(CAST(c_custkey % 150 AS INTEGER)) AS updated_at,
       TIMESTAMP '2001-01-01 00:00:00' + to_days(CAST(c_custkey % 150 AS INTEGER)) AS valid_from,
       TIMESTAMP '{END_OF_TIME}' AS valid_to
FROM customer""",
    "care_events": """
SELECT o_orderkey AS id, o_custkey AS plant_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS event_type_id,
       o_orderdate AS event_date,
       IF(o_orderkey % 5 = 2, repeat(o_orderpriority, 10), o_orderpriority) AS description,
       CASE o_orderkey % 3 WHEN 0 THEN repeat(o_orderpriority, 4) WHEN 1 THEN 'ok' END AS notes,
       CAST(NULL AS TIMESTAMP) AS reminder_date, o_orderstatus = 'F' AS is_completed,
       o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS created_at,
       o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS updated_at
FROM orders""",
    "reminders": """
SELECT o_orderkey AS id, o_custkey AS plant_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS event_type_id,
       o_orderdate + INTERVAL 9 HOUR AS reminder_date,
       CASE WHEN o_orderkey % 101 <> 0 THEN o_orderpriority END AS message,
       o_orderstatus = 'P' AS is_sent, o_orderkey % 5 = 0 AS is_completed, o_orderdate AS created_at
FROM orders WHERE o_orderstatus <> 'F'""",
    "measurements": """
SELECT event_id AS id,
       CASE WHEN event_id % 701 = 0 THEN NULL WHEN event_id % 809 = 0 THEN -event_id
            WHEN event_id % 50 = 0 THEN 200 + (event_id // 50) % 1000 ELSE user_id END AS plant_id,
       CASE WHEN event_id % 997 = 0 THEN NULL WHEN user_id % 7 = 3 THEN ts - INTERVAL 60 DAY
            WHEN user_id % 5 = 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) ELSE ts END AS measurement_date,
       CASE WHEN event_id % 313 = 0 THEN value + 1000 WHEN event_type = 'error' THEN NULL ELSE value END AS height_cm,
       IF(event_id % 317 = 0, -1.0::DOUBLE, value * 0.8) AS width_cm,
       IF(event_id % 401 = 0, -1, CAST(json_extract_string(props, '$.k') AS INTEGER)) AS leaf_count,
       IF(event_id % 499 = 0, 10000, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4) AS flower_count,
       IF(event_id % 601 = 0, 9, NULLIF(CAST(json_extract_string(props, '$.k') AS INTEGER) % 6, 0)) AS health_status,
       IF(event_id % 11 = 0, repeat(event_type, 12), event_type) AS notes
FROM events""",
    "plant_images": """
SELECT doc_id AS id, IF(doc_id % 89 = 0, -1 - doc_id, doc_id % 300) AS plant_id, CASE WHEN doc_id % 97 <> 0 THEN source END AS filename,
       CASE doc_id % 10 WHEN 7 THEN source WHEN 8 THEN source || '.tar.gz' WHEN 9 THEN source || '.PNG'
            ELSE source || '.jpg' END AS original_filename,
       TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id // 3 AS INTEGER)) AS upload_date,
       lang AS description, n_chars AS file_size, 'image/jpeg' AS mime_type
FROM documents""",
    "plant_changes": """
SELECT o.o_custkey AS id, p.name, p.plant_type_id, p.planted_date, o.o_orderpriority AS location, p.notes,
       p.is_active, p.created_at, o.o_orderdate AS updated_at,
       CASE WHEN row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) = 1 THEN 'INSERT'
            WHEN row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) = 1
                 AND o.o_orderstatus = 'P' THEN 'DELETE'
            ELSE 'UPDATE' END AS operation_type,
       'etl' AS changed_by, o.o_orderdate AS changed_at, o.o_orderkey AS seq
FROM orders o JOIN plants p ON p.id = o.o_custkey""",
}

_ROLE_ORDER = [
    "plant_types",
    "event_types",
    "plants",
    "care_events",
    "reminders",
    "measurements",
    "plant_images",
    "plant_changes",
]


def with_roles(body: str) -> str:
    """Prefix an oracle query with the role CTEs it mentions."""
    used = [r for r in _ROLE_ORDER if r in body or (r == "plants" and "plant_changes" in body)]
    if not used:
        return body
    ctes = ",\n".join(f"{r} AS ({ROLE_CTES[r]}\n)" for r in used)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
