"""SQL table functions and the stabbing join."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tendril.functions.days import END_OF_TIME
from tendril.operators.intervals import stabbing_join
from tendril.plans import analytics as A
from tendril.plans import sql as SQL
from tendril.sources.roles import CHANGES_AS_OF, EVENTS_AS_OF, MEASURE_AS_OF, role_tables
from tests.conftest import SF001
from tests.plan_tools import plan_text as plan_of


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0


@pytest.fixture(scope="module")
def functions(spark):
    t = role_tables(spark, SF001)
    assert len(SQL.register_functions(spark, t, MEASURE_AS_OF)) == 8
    return t


def test_functions_equal_the_dataframe_functions(spark, functions):
    t, at = functions, f"TIMESTAMP_NTZ'{EVENTS_AS_OF}'"
    assert same(spark.sql("SELECT * FROM active_plants()"), A.active_plants(t, MEASURE_AS_OF))
    assert same(spark.sql(f"SELECT * FROM needs_attention({at})"), A.needs_attention(t, EVENTS_AS_OF).drop("urgency_label"))
    assert same(spark.sql("SELECT * FROM health_analysis()"), A.health_analysis(t, MEASURE_AS_OF))
    early = f"TIMESTAMP_NTZ'{CHANGES_AS_OF}'"
    for call, days in ((f"upcoming_reminders(as_of => {early})", 7), (f"upcoming_reminders(900, {early})", 900)):
        assert same(spark.sql(f"SELECT * FROM {call}"), A.upcoming_reminders(t, CHANGES_AS_OF, days))
    trend = A.measurement_trend(t, MEASURE_AS_OF).where("plant_id = 5").drop("plant_id", "id")
    assert trend.count() > 0 and same(spark.sql("SELECT * FROM measurement_trend(5)"), trend)
    assert same(spark.sql("SELECT * FROM growth_stats(5)"), A.growth_stats(t).where("plant_id = 5"))


def test_lateral_calls_are_joins(spark, functions):
    every = spark.sql("SELECT p.id, g.* FROM care_plants p, LATERAL growth_stats(p.id) g")
    assert same(every.drop("id"), A.growth_stats(functions))
    plan = plan_of(every)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    kept = spark.sql("SELECT p.id, h.seen FROM care_plants p LEFT JOIN LATERAL "
                     "(SELECT count(*) AS seen FROM plant_history(p.id)) h ON true")  # fmt: skip
    assert kept.count() == functions.plants.count()
    assert spark.sql("SELECT * FROM plant_at_time(NULL, NULL)").count() == 0


def test_time_of_the_call_is_the_default(spark, functions):
    SQL.register_functions(spark, functions)
    assert spark.sql("SELECT * FROM upcoming_reminders()").count() == 0
    SQL.register_functions(spark, functions, MEASURE_AS_OF)
    with pytest.raises(ValueError):
        SQL.register_functions(spark, functions, "2024-01-01' OR '1'='1")


def _rows(seed, n, m):
    rnd, base = random.Random(seed), dt.datetime(1999, 12, 1)
    when = lambda: base + dt.timedelta(hours=rnd.randrange(0, 24 * 365 * 9))
    points = [(i, rnd.choice([1, 1, 1, 2, None]), rnd.choice([when(), when(), when(), None])) for i in range(n)]
    spans = []
    for j in range(m):
        a = when()
        b = rnd.choice([a, a + dt.timedelta(hours=rnd.randrange(0, 900)), when(), dt.datetime.fromisoformat(END_OF_TIME), None])
        spans.append((rnd.choice([1, 1, 2, 3, None]), rnd.choice([a, a, None]), b, f"v{j}"))
    spans += [(1, dt.datetime(2000, 1, 1), dt.datetime(2002, 1, 1), "blocks"), (1, dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 1), "empty")]
    points += [(1000 + k, 1, t) for k, t in enumerate([dt.datetime(2000, 1, 1), dt.datetime(2001, 12, 31, 23), dt.datetime(2002, 1, 1)])]
    return points, spans + spans[:3]


@pytest.mark.parametrize("seed", [1, 2])
def test_stabbing_join_equals_all_pairs(spark, seed):
    points, spans = _rows(seed, 150, 120)
    p = spark.createDataFrame(points, "id long, plant long, at timestamp_ntz")
    v = spark.createDataFrame(spans, "plant long, valid_from timestamp_ntz, valid_to timestamp_ntz, name string")
    got = sorted((r.id, r.v_name) for r in stabbing_join(p, v, "plant", "at").collect())
    want = sorted((i, n) for i, k, t in points for q, a, b, n in spans
                  if k is not None and k == q and None not in (t, a, b) and a <= t < b)
    assert got == want and len(want) > 100


def test_stabbing_join_forms_no_pairs_of_a_hot_key(spark):
    # one key, many short intervals: all pairs would be 4 million
    n = 2000
    v = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("v"),
                              F.expr("timestampadd(DAY, id, timestamp_ntz'2000-01-15')").alias("valid_from"),
                              F.expr("timestampadd(DAY, id + 1, timestamp_ntz'2000-01-15')").alias("valid_to"))
    p = v.select("k", F.col("v").alias("id"), F.col("valid_from").alias("at"))
    out = stabbing_join(p, v, "k", "at")
    assert out.where("id = v_v").count() == out.count() == n
    plan = plan_of(out)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert stabbing_join(p.limit(0), v, "k", "at").count() == 0 == stabbing_join(p, v.limit(0), "k", "at").count()


@pytest.mark.parametrize("dense", [0, 20, 60])
def test_stabbing_join_of_crowded_and_other_keys_equals_all_pairs(spark, dense):
    points, spans = _rows(3, 150, 120)
    p = spark.createDataFrame(points, "id long, plant long, at timestamp_ntz")
    v = spark.createDataFrame(spans, "plant long, valid_from timestamp_ntz, valid_to timestamp_ntz, name string")
    got = stabbing_join(p, v, "plant", "at", dense=dense)
    every = stabbing_join(p, v, "plant", "at", dense=len(points))
    assert got.columns == every.columns and got.exceptAll(every).count() == 0 == every.exceptAll(got).count()
    assert every.count() > 100 and "Generate" in plan_of(got)


def test_stabbing_join_copies_no_interval_of_a_key_of_few_points(spark):
    points, spans = _rows(4, 150, 120)
    p = spark.createDataFrame(points, "id long, plant long, at timestamp_ntz")
    v = spark.createDataFrame(spans, "plant long, valid_from timestamp_ntz, valid_to timestamp_ntz, name string")
    assert "Generate" not in plan_of(stabbing_join(p, v, "plant", "at"))
