"""Operators on hand-made edge rows and against brute force."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tendril.functions.days import calendar_days, floor_days, whole_days
from tendril.functions.labels import round_ratio
from tendril.operators.latest import latest_per_key
from tendril.operators.sequence import asof_join, with_neighbours

D = dt.datetime


def test_day_rules(spark):
    df = spark.createDataFrame(
        [(D(2024, 1, 2, 22), D(2024, 1, 1, 23)), (D(2024, 1, 1, 0), D(2024, 1, 3, 12)), (D(2024, 1, 1), D(2024, 1, 1))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    rows = df.select(
        whole_days("a", "b").alias("w"), calendar_days("a", "b").alias("c"), floor_days("a", "b").alias("f")
    ).collect()
    # 23 h across midnight: 0 whole days, 1 calendar day; -2.5 days: -2 truncated, -3 floored
    assert [(r.w, r.c, r.f) for r in rows] == [(0, 1, 0), (-2, -2, -3), (0, 0, 0)]


def test_round_ratio_half_away_from_zero(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (107, 40), (0, 3), (5, 0)], "n long, d long")
    got = [r.r for r in df.select(round_ratio(F.col("n"), F.col("d"), 2).alias("r")).collect()]
    assert got == [0.13, -0.13, 2.68, 0.0, None]


def test_latest_per_key_null_dates_are_newest(spark):
    df = spark.createDataFrame(
        [(1, 1, D(2024, 1, 1), 5), (2, 1, None, 3), (3, 2, D(2024, 1, 1), 1), (4, 2, D(2024, 1, 1), None)],
        "id long, plant_id long, measurement_date timestamp_ntz, health_status int",
    )
    got = {r.plant_id: (r.id, r.health_status) for r in latest_per_key(df, "plant_id", ["id", "health_status"], "measurement_date").collect()}
    # NULL date sorts first under DESC (PostgreSQL); equal dates: greatest id; NULL value kept
    assert got == {1: (2, 3), 2: (4, None)}
    nn = latest_per_key(df, "plant_id", ["id"], "measurement_date", where=F.col("health_status").isNotNull())
    assert {r.plant_id: r.id for r in nn.collect()} == {1: 2, 2: 3}


def _skewed(spark, n_hot=3000, n_cold=200):
    rows = []
    for i in range(n_hot):  # one plant with most rows, equal times included
        rows.append((i, 7, D(2024, 1, 1) + dt.timedelta(minutes=(i // 3) * 7), float(i % 13)))
    for i in range(n_cold):
        rows.append((n_hot + i, i % 40, D(2024, 1, 1) + dt.timedelta(hours=i), float(i % 5)))
    rows.append((99999, 7, None, 1.0))  # NULL time sorts last
    return spark.createDataFrame(rows, "id long, plant_id long, ts timestamp_ntz, v double")


def test_neighbours_equal_plain_window_under_skew(spark):
    df = _skewed(spark)
    order = [F.col("ts").isNull(), F.col("ts"), F.col("id")]
    w = Window.partitionBy("plant_id").orderBy(*order)
    plain = df.select(
        "id",
        F.lag("v").over(w).alias("prev_v"),
        F.lead("v").over(w).alias("next_v"),
        F.row_number().over(Window.partitionBy("plant_id").orderBy(*[o.desc() for o in order])).alias("rk"),
    )
    for target in (10_000_000, 100, 7):
        got = with_neighbours(df, "plant_id", order, ["v"], "ts", prev=True, next_=True, rank_desc="rk", target_rows=target)
        assert got.count() == df.count()
        assert got.select("id", "prev_v", "next_v", "rk").exceptAll(plain).count() == 0


def test_asof_join_equals_range_join(spark):
    versions = spark.createDataFrame(
        [
            (1, D(2024, 1, 1), D(2024, 1, 5), 1, "a"),
            (1, D(2024, 1, 5), D(2024, 1, 5), 2, "zero-length"),
            (1, D(2024, 1, 5), D(2024, 1, 9), 3, "b"),
            (1, D(2024, 1, 12), D(9999, 12, 31), 4, "c"),  # gap 9..12 = deleted
            (2, D(2024, 1, 3), D(9999, 12, 31), 5, "x"),
        ],
        "k long, vf timestamp_ntz, vt timestamp_ntz, seq long, val string",
    )
    facts = spark.createDataFrame(
        [(i, 1 + i % 3, D(2023, 12, 30) + dt.timedelta(hours=11 * i)) for i in range(60)] + [(100, 1, None)],
        "fid long, k long, t timestamp_ntz",
    )
    brute = (
        facts.join(versions, (facts.k == versions.k) & (versions.vf <= facts.t) & (versions.vt > facts.t), "left")
        .select("fid", "val")
    )
    for target in (1_000_000, 3):
        got = asof_join(facts, versions, "k", "t", "vf", ["val", "vt"], right_order="seq", target_rows=target)
        got = got.select("fid", F.when(F.col("vt") > F.col("t"), F.col("val")).alias("val"))
        assert got.count() == facts.count()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, brute.collect()), key=repr)


def test_match_flag_same_lineage_and_duplicate_keys(spark):
    from tendril.plans.quality import with_match_flag

    base = spark.createDataFrame([(i, i % 3 == 0) for i in range(30)], "id long, sent boolean")
    ids = base.where("sent").select("id").unionByName(base.where("sent").select("id"))  # repeated keys
    out = with_match_flag(base, "id", ids, "id", "hit")
    assert out.count() == 30
    assert {r.id for r in out.where("hit").collect()} == {i for i in range(30) if i % 3 == 0}


def test_source_labels(spark):
    from tendril.functions.labels import source_label

    df = spark.createDataFrame([("UP",), ("STALE",), ("not-a-code",), (None,)], "c string")
    got = [r.l for r in df.select(source_label("c").alias("l")).collect()]
    assert got == ["Raste", "ZASTARJELI PODACI", "not-a-code", None]


def test_slices_are_monotone_in_a_daylight_saving_gap(spark):
    from tendril.functions.days import ntz_micros

    # 2024-03-10 02:00-03:00 does not exist in America/New_York
    times = [D(2024, 3, 10, 1, 50), D(2024, 3, 10, 2, 30), D(2024, 3, 10, 3, 0), D(2024, 3, 10, 3, 10)]
    df = spark.createDataFrame([(i, 1, t, float(i)) for i, t in enumerate(times * 5)], "id long, k long, t timestamp_ntz, v double")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        m = [r.m for r in df.select(ntz_micros("t").alias("m")).orderBy("t").collect()]
        assert m == sorted(m)
        order = [F.col("t").isNull(), F.col("t"), F.col("id")]
        w = Window.partitionBy("k").orderBy(*order)
        exp = df.select("id", F.lag("v").over(w).alias("prev_v"))
        got = with_neighbours(df, "k", order, ["v"], "t", target_rows=3).select("id", "prev_v")
        assert got.exceptAll(exp).count() == 0 and got.count() == exp.count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_event_badge_compares_times_for_overdue(spark):
    from tendril.functions.days import as_ts, calendar_days
    from tendril.functions.labels import event_status

    now = as_ts("2024-07-01 12:00:00")
    df = spark.createDataFrame(
        [(D(2024, 7, 1, 8), False), (D(2024, 7, 1, 18), False), (D(2024, 7, 3), False), (D(2024, 6, 1), True)],
        "event_date timestamp_ntz, is_completed boolean",
    )
    days = calendar_days(F.col("event_date"), now)
    got = [r.s for r in df.select(event_status("event_date", "is_completed", days, now).alias("s")).collect()]
    assert got == ["OVERDUE", "URGENT", "PLANNED", "DONE"]


def test_dimension_broadcast_only_under_the_bound(spark):
    from tendril.operators.dims import MAX_ROWS_CONF, Dim
    from tests.plan_tools import plan_text

    dim = spark.range(50).withColumnRenamed("id", "k")
    fact = spark.range(1000).withColumn("k", F.col("id") % 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan_text(fact.join(Dim(dim).for_join(), "k"), "simple")
        spark.conf.set(MAX_ROWS_CONF, "10")
        d = Dim(dim)
        assert not d.small and "BroadcastHashJoin" not in plan_text(fact.join(d.for_join(), "k"), "simple")
    finally:
        spark.conf.unset(MAX_ROWS_CONF)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))


def test_burst_at_one_instant_is_split_and_exact(spark):
    from tendril.operators.sequence import PART, split_hot

    rows = [(i, 1, D(2024, 1, 1, 12), float(i % 7)) for i in range(900)]  # one instant, 900 rows
    rows += [(1000 + i, 1, D(2024, 1, 1) + dt.timedelta(minutes=37 * i), 1.0) for i in range(60)]  # around it
    rows += [(2000 + i, 2, D(2024, 1, 2) + dt.timedelta(hours=i), 2.0) for i in range(30)]  # a normal plant
    rows += [(3000 + i, 1, None, 3.0) for i in range(5)]  # NULL times last
    df = spark.createDataFrame(rows, "id long, k long, t timestamp_ntz, v double")
    late = df.withColumn("late", F.col("t").isNull())
    cold, hot = split_hot(late, "k", ["late", "t", "id"], 50)
    assert {r.k for r in cold.select("k").distinct().collect()} == {2}
    assert hot.groupBy("k", PART).count().agg(F.max("count")).first()[0] <= 100  # the 900-row instant is cut by id
    order = [F.col("t").isNull(), F.col("t"), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    exp = df.select(
        "id",
        F.lag("v").over(w).alias("prev_v"),
        F.lead("v").over(w).alias("next_v"),
        F.row_number().over(Window.partitionBy("k").orderBy(*[o.desc() for o in order])).alias("rk"),
    )
    got = with_neighbours(df, "k", order, ["v"], "t", prev=True, next_=True, rank_desc="rk", target_rows=50)
    assert got.count() == df.count()
    assert got.select("id", "prev_v", "next_v", "rk").exceptAll(exp).count() == 0


def test_asof_burst_is_split_and_exact(spark):
    from tendril.operators.sequence import asof_join

    inst = D(2024, 1, 1, 12)
    versions = [(1, inst, i, f"v{i}") for i in range(300)]  # 300 versions at one instant
    versions += [(1, D(2024, 1, 1, 1) + dt.timedelta(minutes=7 * i), 1000 + i, f"w{i}") for i in range(40)]
    facts = [(i, 1, inst) for i in range(400)]  # 400 facts at the same instant
    facts += [(1000 + i, 1, D(2024, 1, 1) + dt.timedelta(minutes=13 * i)) for i in range(100)]
    v = spark.createDataFrame(versions, "k long, vf timestamp_ntz, seq long, val string")
    f = spark.createDataFrame(facts, "fid long, k long, t timestamp_ntz")
    got = {r.fid: r.val for r in asof_join(f, v, "k", "t", "vf", ["val"], right_order="seq", target_rows=50).collect()}
    exp = {}
    for fid, k, t in facts:
        cands = [(vf, seq, val) for kk, vf, seq, val in versions if kk == k and vf <= t]
        exp[fid] = max(cands)[2] if cands else None
    assert got == exp


def test_stray_dates_do_not_keep_a_hot_key_whole(spark):
    """Parts are cut by row counts: one row of 1970, rows without a time and a
    burst in one day leave no part above twice the target, results stay exact."""
    from tendril.operators.sequence import PART, split_hot

    rows = [(f"r{i:05d}", "a", D(2024, 1, 1) + dt.timedelta(seconds=i // 3), float(i % 11)) for i in range(4000)]
    rows += [("x1", "a", D(1970, 1, 1), 1.0), ("x2", "a", D(9999, 1, 1), 2.0), ("x3", "a", None, 3.0), ("x4", None, None, 4.0)]
    rows += [(f"n{i}", None, D(2024, 1, 1), 5.0) for i in range(300)]  # a hot NULL key
    df = spark.createDataFrame(rows, "id string, k string, t timestamp_ntz, v double")
    late = df.withColumn("late", F.col("t").isNull())
    _, hot = split_hot(late, "k", ["late", "t", "id"], 100)
    assert hot.groupBy("k", PART).count().agg(F.max("count")).first()[0] <= 200
    order = [F.col("t").isNull(), F.col("t"), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    exp = df.select("id", F.lag("v").over(w).alias("prev_v"), F.lead("v").over(w).alias("next_v"))
    got = with_neighbours(df, "k", order, ["v"], "t", prev=True, next_=True, target_rows=100)
    assert got.count() == df.count()
    assert got.select("id", "prev_v", "next_v").exceptAll(exp).count() == 0


def test_hot_answer_is_not_remembered(spark, scratch):
    """A table that grows a hot key under the same path is split on the next call."""
    from tendril.operators.sequence import split_hot

    def write(n):
        spark.range(n).selectExpr("id", "1 k", "cast('2024-01-01' as timestamp_ntz) t").write.mode("overwrite").parquet(scratch)

    write(5)
    assert split_hot(spark.read.parquet(scratch), "k", ["t", "id"], 10)[1] is None
    write(50)
    assert split_hot(spark.read.parquet(scratch), "k", ["t", "id"], 10)[1] is not None
