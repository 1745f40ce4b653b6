"""Randomised checks of the custom operators against plain Spark / brute force."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tendril.operators.sequence import asof_join, with_neighbours

BASE = dt.datetime(2024, 1, 1)
rows_st = st.lists(
    st.tuples(
        st.integers(0, 3),  # key (few keys -> heavy ones)
        st.one_of(st.none(), st.integers(0, 40)),  # hours after BASE, NULLs and ties
        st.one_of(st.none(), st.floats(-5, 5, allow_nan=False)),
    ),
    min_size=1,
    max_size=60,
)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(rows=rows_st, target=st.integers(1, 8))
def test_neighbours_random(spark, rows, target):
    data = [(i, k, None if h is None else BASE + dt.timedelta(hours=h), v) for i, (k, h, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, k long, t timestamp_ntz, v double")
    order = [F.col("t").isNull(), F.col("t"), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    exp = df.select(
        "id",
        F.lag("v").over(w).alias("prev_v"),
        F.lead("v").over(w).alias("next_v"),
        F.row_number().over(Window.partitionBy("k").orderBy(*[o.desc() for o in order])).alias("rk"),
    )
    got = with_neighbours(df, "k", order, ["v"], "t", prev=True, next_=True, rank_desc="rk", target_rows=target)
    assert sorted(map(tuple, got.select("id", "prev_v", "next_v", "rk").collect())) == sorted(map(tuple, exp.collect()))


@SETTINGS
@given(
    versions=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(0, 10)), max_size=25),
    facts=st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(0, 35))), min_size=1, max_size=40),
    target=st.integers(1, 6),
)
def test_asof_random(spark, versions, facts, target):
    vrows = [(k, BASE + dt.timedelta(hours=h), i, f"v{i}") for i, (k, h, _) in enumerate(versions)]
    frows = [(i, k, None if h is None else BASE + dt.timedelta(hours=h)) for i, (k, h) in enumerate(facts)]
    v = spark.createDataFrame(vrows, "k long, vf timestamp_ntz, seq long, val string")
    f = spark.createDataFrame(frows, "fid long, k long, t timestamp_ntz")
    got = asof_join(f, v, "k", "t", "vf", ["val"], right_order="seq", target_rows=target).select("fid", "val")
    # brute force on the driver over the tiny fixture
    exp = []
    for fid, k, t in frows:
        cands = [(vf, seq, val) for kk, vf, seq, val in vrows if kk == k and t is not None and vf <= t]
        exp.append((fid, max(cands)[2] if cands else None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(exp, key=repr)


@SETTINGS
@given(
    feed=st.lists(
        st.tuples(st.integers(0, 2), st.integers(0, 20), st.sampled_from(["INSERT", "UPDATE", "DELETE"])),
        min_size=1,
        max_size=30,
    ),
    at=st.integers(0, 22),
    target=st.integers(1, 5),
)
def test_scd2_point_in_time_equals_replay(spark, feed, at, target):
    """Versions from the change feed, looked up at t, equal a replay of the
    feed up to t (last change by (time, seq) wins; DELETE removes)."""
    from tendril.operators.sequence import TARGET_ROWS_CONF
    from tendril.plans import temporal as TM
    from tendril.sources import schemas

    rows = [
        (k, f"p{k}", None, None, f"loc{seq}", None, True, None, None, op, "u", BASE + dt.timedelta(hours=h), seq)
        for seq, (k, h, op) in enumerate(feed)
    ]
    ch = spark.createDataFrame(rows, schemas.PLANT_CHANGES)
    spark.conf.set(TARGET_ROWS_CONF, str(target))
    try:
        got = {r.id: r.location for r in TM.as_of_lookup(TM.scd2_build(ch), BASE + dt.timedelta(hours=at)).collect()}
    finally:
        spark.conf.unset(TARGET_ROWS_CONF)
    state = {}
    for k, _, _, _, loc, _, _, _, _, op, _, t, seq in sorted(rows, key=lambda r: (r[11], r[12])):
        if t > BASE + dt.timedelta(hours=at):
            break
        if op == "DELETE":
            state.pop(k, None)
        else:
            state[k] = loc
    # a change at exactly t is in effect at t, except a zero-length version
    # (another change of the key at the same instant) which no instant sees
    assert got == state


burst_rows = st.lists(
    st.tuples(st.integers(0, 1), st.one_of(st.none(), st.integers(0, 2)), st.floats(-5, 5, allow_nan=False)),
    min_size=5,
    max_size=80,
)


@SETTINGS
@given(rows=burst_rows, target=st.integers(1, 4))
def test_neighbours_random_bursts(spark, rows, target):
    """Few instants, many rows each: bursts are cut by id and stay exact."""
    data = [(i, k, None if h is None else BASE + dt.timedelta(hours=h), v) for i, (k, h, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, k long, t timestamp_ntz, v double")
    order = [F.col("t").isNull(), F.col("t"), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    exp = df.select("id", F.lag("v").over(w).alias("prev_v"), F.lead("v").over(w).alias("next_v"))
    got = with_neighbours(df, "k", order, ["v"], "t", prev=True, next_=True, target_rows=target)
    assert sorted(map(tuple, got.select("id", "prev_v", "next_v").collect())) == sorted(map(tuple, exp.collect()))


@SETTINGS
@given(
    versions=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 2)), max_size=40),
    facts=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 3)), min_size=1, max_size=60),
    target=st.integers(1, 4),
)
def test_asof_random_bursts(spark, versions, facts, target):
    vrows = [(k, BASE + dt.timedelta(hours=h), i, f"v{i}") for i, (k, h) in enumerate(versions)]
    frows = [(i, k, BASE + dt.timedelta(hours=h)) for i, (k, h) in enumerate(facts)]
    v = spark.createDataFrame(vrows, "k long, vf timestamp_ntz, seq long, val string")
    f = spark.createDataFrame(frows, "fid long, k long, t timestamp_ntz")
    got = asof_join(f, v, "k", "t", "vf", ["val"], right_order="seq", target_rows=target).select("fid", "val")
    exp = []
    for fid, k, t in frows:
        cands = [(vf, seq, val) for kk, vf, seq, val in vrows if kk == k and vf <= t]
        exp.append((fid, max(cands)[2] if cands else None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(exp, key=repr)
