"""Data-quality checks (DQ-1 .. DQ-6): the source's DDL constraints, form
validators and function guards as violation rows and good/rejected splits.

Row rules run in one pass per table: each rule is a boolean "violates"
column; the failing rules are exploded (NULL entries dropped), so there is one
scan whatever the number of rules.  No higher-order functions (lambdas) are
used: they would take the rules out of whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

VIOLATION_COLS = ["table_name", "rule", "column_name", "row_key"]


@dataclass(frozen=True)
class Rule:
    rule: str
    column: str
    violates: Column  # TRUE = the row breaks the rule (NULL counts as passing)


def not_null(cols: Iterable[str], blank_is_missing: bool = False) -> list[Rule]:
    """DQ-1: required columns (optionally an all-blank string is missing too)."""
    out = []
    for c in cols:
        v = F.col(c).isNull()
        if blank_is_missing:
            v = v | (F.trim(F.col(c).cast("string")) == "")
        out.append(Rule("not_null", c, v))
    return out


def in_range(col: str, lo, hi) -> Rule:
    """DQ-3: ``lo <= col <= hi``; NULL passes."""
    c = F.col(col)
    return Rule("range", col, c.isNotNull() & ~c.between(lo, hi))


def allowed(col: str, values: Sequence, lower: bool = False) -> Rule:
    """DQ-3: value in an allowed set; NULL passes."""
    c = F.lower(F.col(col)) if lower else F.col(col)
    return Rule("allowed", col, F.col(col).isNotNull() & ~c.isin(list(values)))


def extension_allowed(col: str, exts: Sequence[str]) -> Rule:
    """X-4 / DQ-3: a dot is present and the last extension (lower case) is allowed."""
    name = F.col(col)
    ext = F.lower(F.substring_index(name, ".", -1))
    return Rule("extension", col, name.isNotNull() & ((F.instr(name, ".") == 0) | ~ext.isin(list(exts))))


def length_between(col: str, lo: int, hi: int) -> Rule:
    """DQ-4: character length in ``lo..hi``; NULL passes."""
    n = F.char_length(F.col(col))
    return Rule("length", col, F.col(col).isNotNull() & ((n < lo) | (n > hi)))


def with_match_flag(
    df: DataFrame, col: str, other: DataFrame, other_col: str, flag: str, unique: bool = False
) -> DataFrame:
    """Add ``flag``: whether ``other`` has a row with ``other_col = col`` (FALSE for NULL).

    A left join to a unique key, which AQE can split where a key of ``df`` is
    hot.  ``unique=True`` promises that ``other_col`` has no repeated values
    (a primary key); else they are made distinct first."""
    key, hit = f"__{flag}_key", f"__{flag}_hit"
    o = other.where(F.col(other_col).isNotNull()).select(F.col(other_col).alias(key))
    o = (o if unique else o.distinct()).withColumn(hit, F.lit(True))
    return df.join(o, F.col(col) == F.col(key), "left").withColumn(flag, F.col(hit).isNotNull()).drop(key, hit)


def _hits(rules: Sequence[Rule]) -> Column:
    """Array with the rule and column of every rule, NULL for those that the row keeps."""
    return F.array(
        *[F.when(r.violates, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.column).alias("column_name"))) for r in rules]
    )


def _exploded(checked: DataFrame) -> DataFrame:
    out = checked.select("table_name", "row_key", F.explode("hits").alias("_v")).where(F.col("_v").isNotNull())
    return out.select("table_name", "_v.rule", "_v.column_name", "row_key")


def row_violations(df: DataFrame, table: str, key: str, rules: Sequence[Rule]) -> DataFrame:
    """One row per (row, broken rule): table_name, rule, column_name, row_key."""
    return _exploded(
        df.where(any_violation(rules)).select(
            F.lit(table).alias("table_name"), F.col(key).cast("long").alias("row_key"), _hits(rules).alias("hits")
        )
    )


@dataclass(frozen=True)
class Child:
    """A table or batch with a ``plant_id``: its own rules, and what the plant must be
    (``foreign_key``: any plant; ``choice``: an active one).  ``choices`` = (column,
    dimension, dimension column, rule name) for columns that name a row of a small table."""

    df: DataFrame
    table: str
    rules: Sequence[Rule]
    key: str = "id"
    plant_rule: str = "foreign_key"
    choices: Sequence[tuple] = ()


def child_violations(children: Sequence[Child], plants: DataFrame) -> DataFrame:
    """Violations of all children.  Each child is scanned once and reduced to its key,
    its plant and its broken rules; the union of these slim rows is joined to the
    plants once, so the plants are shuffled once whatever the number of children."""
    slim = []
    for c in children:
        df, rules = c.df, list(c.rules)
        for i, (col, dim, dim_col, name) in enumerate(c.choices):
            df = with_match_flag(df, col, dim, dim_col, f"_in{i}", unique=True)
            rules.append(Rule(name, col, F.col(col).isNotNull() & ~F.col(f"_in{i}")))
        slim.append(
            df.select(
                F.lit(c.table).alias("table_name"),
                F.col(c.key).cast("long").alias("row_key"),
                F.col("plant_id").cast("long").alias("plant_id"),
                F.lit(c.plant_rule).alias("plant_rule"),
                _hits(rules).alias("hits"),
            )
        )
    rows = reduce(DataFrame.unionByName, slim)
    p = plants.where(F.col("id").isNotNull()).select(
        F.col("id").cast("long").alias("_plant"), F.coalesce("is_active", F.lit(False)).alias("_active")
    )
    joined = rows.join(p, F.col("plant_id") == F.col("_plant"), "left")
    good = F.col("_plant").isNotNull() & ((F.col("plant_rule") != "choice") | F.col("_active"))
    one = F.when(F.col("plant_id").isNotNull() & ~good, F.struct(F.col("plant_rule").alias("rule"), F.lit("plant_id").alias("column_name")))
    return _exploded(joined.select("table_name", "row_key", F.concat("hits", F.array(one)).alias("hits")))


def any_violation(rules: Sequence[Rule]) -> Column:
    """TRUE if the row breaks at least one rule (NULL checks count as passing)."""
    return reduce(lambda a, b: a | b, [F.coalesce(r.violates, F.lit(False)) for r in rules])


def unique(df: DataFrame, table: str, col: str, key: str = "id") -> DataFrame:
    """DQ-2: rows whose ``col`` value occurs more than once (NULLs ignored).
    A count per value (partial aggregate), then a semi-join back."""
    dups = df.where(F.col(col).isNotNull()).groupBy(col).count().where(F.col("count") > 1).select(col)
    return df.join(dups, col, "left_semi").select(
        F.lit(table).alias("table_name"), F.lit("unique").alias("rule"), F.lit(col).alias("column_name"),
        F.col(key).cast("long").alias("row_key"),
    )


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """DQ-6: split a batch into good rows and rejected rows (+ ``reasons``,
    the names ``rule:column`` of every broken rule)."""
    joined = F.concat_ws(",", *[F.when(r.violates, F.lit(f"{r.rule}:{r.column}")) for r in rules])
    broken = any_violation(rules)
    good = df.where(~broken)
    bad = df.where(broken).withColumn("reasons", F.split(joined, ","))
    return good, bad


def write_quarantined(df: DataFrame, rules: Sequence[Rule], path: str) -> dict[str, int]:
    """DQ-6 / A-10 as a job: good and rejected rows of a batch written in one scan, to
    ``<path>/rejected=false`` and ``<path>/rejected=true`` (these with ``reasons``), and
    the counts that the same scan observed: ``rows``, ``rejected``, and per rule
    ``rule:column``."""
    seen = Observation()
    names = [f"{r.rule}:{r.column}" for r in rules]
    # one expression per rule: the counts, the split and the reasons share it
    flags = [F.coalesce(r.violates, F.lit(False)) for r in rules]
    marked = df.withColumn("_broken", F.array(*flags))
    broken = F.exists("_broken", lambda x: x)
    reasons = F.filter(F.array(*[F.when(F.get("_broken", F.lit(i)), F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())
    counts = [F.count_if(F.get("_broken", F.lit(i))).alias(n) for i, n in enumerate(names)]
    marked = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(broken).alias("rejected"), *counts)
    out = marked.withColumn("rejected", broken).withColumn("reasons", F.when(F.col("rejected"), reasons)).drop("_broken")
    out.write.mode("overwrite").partitionBy("rejected").parquet(path)
    return dict(seen.get)


# Limits of the source's columns and forms.
MEASUREMENT_RULES_SPEC = {
    "health_status": (1, 5),
    "height_cm": (0, 999.99),
    "width_cm": (0, 999.99),
    "leaf_count": (0, 9999),
    "flower_count": (0, 9999),
}
FREQUENCY_RANGE = (1, 365)
ALLOWED_EXTENSIONS = ["png", "jpg", "jpeg", "gif"]
OPERATIONS = ["INSERT", "UPDATE", "DELETE"]


def measurement_rules() -> list[Rule]:
    return not_null(["plant_id"]) + [in_range(c, lo, hi) for c, (lo, hi) in MEASUREMENT_RULES_SPEC.items()]


def plant_rules() -> list[Rule]:
    return not_null(["name", "planted_date"], blank_is_missing=True) + [
        length_between("name", 1, 100),
        length_between("location", 0, 100),
    ]


def care_table_violations(
    t,
    measurement_requests: DataFrame | None = None,
    event_requests: DataFrame | None = None,
    plant_requests: DataFrame | None = None,
) -> DataFrame:
    """Every check of the care tables as one violation table; request batches (with a
    ``request_id``) get the forms' checks, DQ-5's choices of plant and type among them."""
    ptypes, etypes = t.dim("plant_types"), t.dim("event_types")
    images = not_null(["filename"]) + [extension_allowed("original_filename", ALLOWED_EXTENSIONS)]
    children = [
        Child(t.events, "events", not_null(["event_date"]), choices=[("event_type_id", etypes, "id", "foreign_key")]),
        Child(t.reminders, "reminders", not_null(["reminder_date", "message"])),
        Child(t.measurements, "measurements", measurement_rules()),
        Child(t.plant_images, "plant_images", images),
    ]
    if measurement_requests is not None:
        children.append(
            Child(measurement_requests, "measurement_requests", measurement_rules(), "request_id", "choice")
        )
    if event_requests is not None:
        required = not_null(["plant_id", "event_type_id", "event_date"])
        of_type = [("event_type_id", etypes, "id", "choice")]
        children.append(Child(event_requests, "event_requests", required, "request_id", "choice", of_type))
    parts = [
        child_violations(children, t.plants),
        row_violations(t.plants, "plants", "id", plant_rules()),
        unique(t.plant_types, "plant_types", "name"),
        row_violations(
            t.plant_types,
            "plant_types",
            "id",
            not_null(["name"])
            + [length_between("scientific_name", 0, 150)]
            + [in_range(c, *FREQUENCY_RANGE) for c in ("watering_frequency_days", "fertilizing_frequency_days")],
        ),
        unique(t.event_types, "event_types", "name"),
    ]
    if plant_requests is not None:
        chosen = with_match_flag(plant_requests, "plant_type_id", ptypes, "id", "_in", unique=True)
        unlisted = Rule("choice", "plant_type_id", F.col("plant_type_id").isNotNull() & ~F.col("_in"))
        rules = plant_rules() + not_null(["plant_type_id"]) + [unlisted]
        parts.append(row_violations(chosen, "plant_requests", "request_id", rules))
    return reduce(DataFrame.unionByName, parts)


def violation_summary(violations: DataFrame) -> DataFrame:
    return violations.groupBy("table_name", "rule", "column_name").agg(F.count(F.lit(1)).alias("violations"))
