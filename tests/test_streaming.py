"""Streaming jobs (availableNow over parquet folders) equal the batch rules."""

import os

from pyspark.sql import functions as F

from tests.conftest import SF001
from tendril.plans import rules as R
from tendril.plans import temporal as TM
from tendril.plans import views as V
from tendril.session import checkpoint_path
from tendril.sources import schemas
from tendril.sources.roles import EVENTS_AS_OF, MEASURE_AS_OF, role_tables
from tendril.streaming import jobs as S
from tendril.streaming import store


def _as_files(df, path, parts=4):
    df.repartition(parts).write.mode("overwrite").parquet(path)
    return path


def _run(stream_df, name, mode="append"):
    q = stream_df.writeStream.format("memory").queryName(name).outputMode(mode)
    q = q.option("checkpointLocation", checkpoint_path(stream_df.sparkSession, name + str(os.getpid()))).trigger(
        availableNow=True
    )
    h = q.start()
    h.awaitTermination()
    return stream_df.sparkSession.table(name)


def _same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stream_reminders_and_warnings(spark, scratch):
    t = role_tables(spark, SF001)
    ev = S.read_stream(spark, _as_files(t.events, f"{scratch}/events"), schemas.EVENTS, 1)
    got = _run(S.stream_reminders(ev, t, EVENTS_AS_OF), "st_rem")
    assert _same(got, R.event_reminders(t.events, t, EVENTS_AS_OF))
    ms = S.read_stream(spark, _as_files(t.measurements, f"{scratch}/m"), schemas.MEASUREMENTS, 1)
    got = _run(S.stream_health_warnings(ms, t, MEASURE_AS_OF), "st_warn")
    assert _same(got, R.health_warnings(t.measurements, t, MEASURE_AS_OF))


def test_stream_latest(spark, scratch):
    t = role_tables(spark, SF001)
    ms = S.read_stream(spark, _as_files(t.measurements, f"{scratch}/m"), schemas.MEASUREMENTS, 1)
    got = _run(S.stream_latest(ms), "st_latest", mode="complete")
    batch = S.stream_latest(t.measurements)
    assert _same(got, batch)


def _measured(spark):
    t = role_tables(spark, SF001)
    known = t.measurements.join(t.plants.select(F.col("id").alias("plant_id")), "plant_id", "left_semi")
    return t, known.select(*t.measurements.columns)


def test_stream_delta_in_any_order_equals_window(spark, scratch):
    t, m = _measured(spark)
    # files dealt by hash: no order in time at all, and some rows twice
    twice = m.withColumn("_f", F.pmod(F.xxhash64("id"), F.lit(4))).unionByName(
        m.where("id % 3 = 0").withColumn("_f", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(4)))
    )
    for i in range(4):
        twice.where(F.col("_f") == i).drop("_f").coalesce(1).write.parquet(f"{scratch}/any/{i}")
    ms = spark.readStream.schema(schemas.MEASUREMENTS).option("maxFilesPerTrigger", "1").parquet(f"{scratch}/any/*")
    log = _run(S.stream_delta(ms), "st_delta")
    assert log.where("op = -1").count() > 0  # late rows take back what came out before them
    exp = V.growth_timeline(t).select("id", "prev_height", "height_growth")
    assert _same(S.net_rows(log).select("id", "prev_height", "height_growth"), exp)


def test_stream_delta_that_waits_has_no_corrections(spark, scratch):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, i % 2, t0 + dt.timedelta(hours=h), float(i)) for i, h in enumerate([5, 3, 8, 1, 12, 9, 30, 31, 28, 60])]
    for k, part in enumerate([rows[:3], rows[3:6], rows[6:9], rows[9:], [(99, 0, t0 + dt.timedelta(hours=200), 1.0)]]):
        df = spark.createDataFrame(part, "id long, plant_id long, measurement_date timestamp_ntz, height_cm double")
        df.coalesce(1).write.parquet(f"{scratch}/w/{k}")
    ms = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(f"{scratch}/w/*")
    log = _run(S.stream_delta(ms, "24 hours", wait=True), "st_wait").collect()
    assert {r.op for r in log} == {1} and 99 not in {r.id for r in log}
    for plant in (0, 1):
        known = sorted((r[2], r[0], r[3]) for r in rows if r[1] == plant)
        want = [(i, before[2] if before else None) for before, (_, i, _) in zip([None, *known], known)]
        assert sorted((r.id, r.prev_height) for r in log if r.plant_id == plant) == sorted(want)


def test_state_of_a_key_is_freed_by_the_watermark():
    from pyspark.sql import Row

    from tendril.streaming.ordered import _InOrder

    class State:
        rows: list = []

        def getListState(self, *_):
            return self

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

        def registerTimer(self, at):
            self.timer = at

    class Timer:
        at = 0

        def getCurrentWatermarkInMs(self):
            return self.at

    p, state, timer = _InOrder("k", ["h"], None, False), State(), Timer()
    p.init(state)
    feed = lambda *rows: list(p.handleInputRows((7,), iter([Row(_ms=a, _pos=i, h=h) for a, i, h in rows]), timer))
    assert [tuple(r) for r in feed((10, 1, 1.0), (30, 2, 3.0))] == [(7, 1, 1.0, None), (7, 1, 3.0, 1.0)]
    assert state.timer == 31
    late = [tuple(r) for r in feed((20, 3, 2.0))]
    assert late == [(7, 1, 2.0, 1.0), (7, -1, 3.0, 1.0), (7, 1, 3.0, 2.0)]
    assert feed((20, 3, 2.0)) == []  # a replay
    timer.at = 25
    assert list(p.handleExpiredTimer((7,), timer, None)) == [] and [r[1] for r in state.rows] == [3, 2]
    assert [tuple(r) for r in feed((26, 4, 2.5))] == [(7, 1, 2.5, 2.0), (7, -1, 3.0, 2.0), (7, 1, 3.0, 2.5)]
    timer.at = 1000
    assert list(p.handleExpiredTimer((7,), timer, None)) == [] and [r[1] for r in state.rows] == [2]
    assert [tuple(r) for r in feed((None, 5, 9.0), (2000, 6, 4.0))] == [(7, 1, 4.0, 3.0), (7, 1, 9.0, 4.0)]


def _shuffled(spark, df, path, files=5):
    """Micro-batches in an order that has nothing to do with time; every change twice."""
    twice = df.withColumn("_f", F.pmod(F.xxhash64("id", "seq"), F.lit(files))).unionByName(
        df.withColumn("_f", F.pmod(F.xxhash64("seq", F.lit(7)), F.lit(files)))
    )
    for i in range(files):
        twice.where(F.col("_f") == i).drop("_f").coalesce(1).write.parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(f"{path}/*")


def test_stream_audit_rows_equal_batch(spark, scratch):
    t = role_tables(spark, SF001)
    name = f"audit{os.getpid()}"
    S.run_audit_stream(_shuffled(spark, t.plant_changes, f"{scratch}/ch", 3), name).trigger(
        availableNow=True
    ).start().awaitTermination()
    exp = TM.audit_rows(t.plant_changes)
    assert _same(S.current_rows(spark, name, exp.schema).select(*exp.columns), exp)


def test_scd2_stream_with_replays_and_late_changes(spark, scratch):
    t = role_tables(spark, SF001)
    name = f"versions{os.getpid()}"
    S.run_scd2_stream(_shuffled(spark, t.plant_changes, f"{scratch}/ch"), name).trigger(
        availableNow=True
    ).start().awaitTermination()
    exp = TM.scd2_build(t.plant_changes)
    assert _same(S.current_rows(spark, name, exp.schema).select(*exp.columns), exp)


def test_late_change_and_replay_by_hand(spark, scratch):
    import datetime as dt

    D = dt.datetime

    def change(loc, day, seq, op="UPDATE"):
        return (1, "p", None, None, loc, None, True, None, None, op, "u", D(2024, 1, day), seq)

    base = f"{scratch}/v"
    batches = [[change("A", 1, 1, "INSERT")], [change("B", 3, 3)], [change("A", 1, 1, "INSERT")], [change("C", 2, 2)]]
    got = [
        store.rebuild(spark.createDataFrame(rows, schemas.PLANT_CHANGES), i, base, "id", "seq", TM.scd2_build, 4)
        for i, rows in enumerate(batches)
    ]
    assert got[2] is None  # a replay rebuilds nothing
    rows = got[3].orderBy("valid_from").collect()
    assert [(r.location, r.valid_from.day, r.valid_to.year) for r in rows] == [("A", 1, 2024), ("C", 2, 2024), ("B", 3, 9999)]


def test_store_reads_and_rewrites_touched_buckets_only(spark, scratch):
    import glob

    schema, base, n = "k long, v long", f"{scratch}/store", 8
    s = store.BucketStore(spark, base, "k", n)
    empty = spark.createDataFrame([], schema)

    def bucket_files(batch):
        return sorted({int(p.rsplit("=", 1)[1]) for p in glob.glob(f"{base}/data/batch={batch}/bucket=*")})

    def upsert(rows, batch):
        s.clean(batch)
        df = spark.createDataFrame(rows, schema)
        some = s.touched(df)
        old = s.read(empty.schema, some, batch)
        s.replace(old.join(df.select("k"), "k", "left_anti").select("k", "v").unionByName(df), some, batch)
        return some, old

    upsert([(k, 0) for k in range(200)], 0)
    assert bucket_files(0) == list(range(n))
    some, old = upsert([(3, 1), (5, 1)], 1)
    assert len(some) <= 2 and bucket_files(1) == some
    read = {int(f.split("/bucket=")[1].split("/")[0]) for f in old.inputFiles()}
    assert read == set(some)  # no other bucket's files were opened
    upsert([(3, 9)], 1)  # the batch runs again, with other rows: it reads batch 0 and overwrites its own
    assert sorted(map(tuple, s.read(empty.schema).collect())) == sorted([(k, 9 if k == 3 else 0) for k in range(200)])
    upsert([(7, 2)], 2)
    rewritten = s.touched(spark.createDataFrame([(3, 0)], schema))
    assert set(bucket_files(0)).isdisjoint(rewritten)  # replaced files are gone once the next batch has begun
    assert sorted(map(tuple, s.read(empty.schema).collect())) == sorted([(k, {3: 9, 7: 2}.get(k, 0)) for k in range(200)])
    s.replace(empty, s.touched(spark.createDataFrame([(7, 0)], schema)), 3)  # a bucket may become empty
    assert 7 not in {r.k for r in s.read(empty.schema).collect()}


def test_stream_next_events(spark, scratch):
    t = role_tables(spark, SF001)
    ev = t.events.select("id", "plant_id", "event_type_id", "event_date", "is_completed")
    images = ev.withColumn("is_completed", F.lit(False)).withColumn("version", F.lit(1)).unionByName(
        ev.withColumn("version", F.lit(2))
    )
    for i, rows in enumerate([images, images.where("id % 3 = 0"), ev.withColumn("version", F.lit(3))]):
        rows.repartition(2).write.parquet(f"{scratch}/img/{i}")  # replays, and images without a transition
    stream = spark.readStream.schema(images.schema).option("maxFilesPerTrigger", "2").parquet(f"{scratch}/img/*")
    out, rem = f"{scratch}/next", f"{scratch}/rem"
    q = S.run_next_events(stream, t, EVENTS_AS_OF, out, name=f"st_next{os.getpid()}", reminders_path=rem)
    q.trigger(availableNow=True).start().awaitTermination()
    old = t.events.withColumn("is_completed", F.lit(False))
    exp = R.next_events(old, t.events, t, EVENTS_AS_OF)
    assert _same(S.net_rows(spark.read.parquet(out).drop("batch")).select(*exp.columns), exp)
    exp = R.next_event_reminders(old, t.events, t, EVENTS_AS_OF)
    assert _same(S.net_rows(spark.read.parquet(rem).drop("batch")).select(*exp.columns), exp)


def test_late_images_make_and_take_back_completions(spark, scratch):
    import datetime as dt
    from itertools import permutations

    images = [(v, bool(x)) for v, x in ((1, 0), (2, 1), (3, 0), (4, 1))]
    at = dt.datetime(2024, 1, 1)
    # every order of arrival, one event each; an image per micro-batch
    orders = list(permutations(images))
    schema = "id long, plant_id long, event_type_id long, event_date timestamp_ntz, is_completed boolean, version long"
    for step in range(4):
        rows = [(i, 1, 1, at + dt.timedelta(days=o[step][0]), o[step][1], o[step][0]) for i, o in enumerate(orders)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{scratch}/late/{step}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{scratch}/late/*")
    log = _run(S.stream_completions(stream), "st_late")
    got = sorted((r.id, r.event_date.day) for r in S.net_rows(log).collect())
    assert got == sorted((i, d) for i in range(len(orders)) for d in (3, 5))  # versions 2 and 4


def test_dedup_replays(spark, scratch):
    t = role_tables(spark, SF001)
    twice = t.measurements.unionByName(t.measurements)
    ms = S.read_stream(spark, _as_files(twice, f"{scratch}/dup"), schemas.MEASUREMENTS)
    got = _run(S.dedup_replays(ms, "id", "measurement_date"), "st_dedup")
    assert got.count() == t.measurements.count()


def test_reminder_stream_to_parquet_resumes(spark, scratch):
    t = role_tables(spark, SF001)
    src = f"{scratch}/in"
    t.events.where("id % 2 = 0").write.parquet(f"{src}/part1")
    ev = spark.readStream.schema(schemas.EVENTS).parquet(f"{src}/*")
    name = f"st_sink{os.getpid()}"
    S.to_parquet(S.stream_reminders(ev, t, EVENTS_AS_OF), f"{scratch}/out", name, once=True).awaitTermination()
    t.events.where("id % 2 = 1").write.parquet(f"{src}/part2")  # new files arrive
    ev = spark.readStream.schema(schemas.EVENTS).parquet(f"{src}/*")
    S.to_parquet(S.stream_reminders(ev, t, EVENTS_AS_OF), f"{scratch}/out", name, once=True).awaitTermination()
    got = spark.read.parquet(f"{scratch}/out")
    assert _same(got, R.event_reminders(t.events, t, EVENTS_AS_OF))  # each event exactly once


def test_now_is_local_time(spark):
    from tendril.functions.days import as_ts

    v = spark.range(1).select(as_ts(None).alias("t")).first().t
    assert v is not None


def test_latest_snapshot_stream_equals_batch(spark, scratch):
    t = role_tables(spark, SF001)
    src = _as_files(t.measurements, f"{scratch}/m", 4)
    ms = S.read_stream(spark, src, schemas.MEASUREMENTS, 1)
    name = f"latest{os.getpid()}"
    S.run_latest_snapshot(ms, name).trigger(availableNow=True).start().awaitTermination()
    exp = S.stream_latest(t.measurements)
    assert _same(S.latest_snapshot(spark, exp.schema, name), exp)
