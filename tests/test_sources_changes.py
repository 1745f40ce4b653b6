"""Sources (SRC-1, SRC-3), writes (SNK-*), paging, parsing and SCD2 invariants."""

import datetime as dt
import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF001
from tendril.functions.days import format_date, parse_form_datetime
from tendril.operators.paging import page, page_after
from tendril.plans import changes as C
from tendril.plans import quality as Q
from tendril.plans import temporal as TM
from tendril.sources import load_tables, schemas
from tendril.sources.files import file_catalog
from tendril.sources.roles import role_tables

D = dt.datetime


def test_load_tables_roundtrip(spark, scratch):
    t = role_tables(spark, SF001)
    for name in ["plant_types", "plants", "event_types", "events", "plant_images", "reminders", "measurements"]:
        getattr(t, name).write.mode("overwrite").parquet(f"{scratch}/{name}")
    spark.createDataFrame([], schemas.PLANT_HISTORY).write.mode("overwrite").parquet(f"{scratch}/plants_history")
    back = load_tables(spark, scratch)
    assert back.measurements.schema == schemas.MEASUREMENTS
    assert back.events.count() == t.events.count()


def test_file_catalog(spark, scratch):
    os.makedirs(f"{scratch}/img/sub")
    for name, size in [("a.PNG", 10), ("b.jpeg", 20), ("c.txt", 5), ("noext", 3), ("sub/d.v1.gif", 7), ("big.jpg", 40)]:
        with open(f"{scratch}/img/{name}", "wb") as fh:
            fh.write(b"x" * size)
    rows = {r.original_filename: r for r in file_catalog(spark, f"{scratch}/img", max_bytes=30).collect()}
    assert rows["a.PNG"].accepted and rows["a.PNG"].mime_type == "image/png"
    assert rows["d.v1.gif"].accepted and rows["d.v1.gif"].file_size == 7
    assert not rows["c.txt"].accepted and not rows["noext"].accepted
    assert rows["big.jpg"].reject_reason == "file too large"


def test_append_rows_defaults_and_normalise(spark):
    new = spark.createDataFrame(
        [(1, 1, 0, D(2024, 1, 1), None, None, None, None, None, None)], schemas.EVENTS
    )
    out = C.append_rows(C.normalise_missing(new, ["event_type_id"]), "events", "2024-02-01 10:00:00").first()
    assert out.is_completed is False and out.event_type_id is None
    assert out.created_at == D(2024, 2, 1, 10)


def test_complete_and_cascade(spark):
    t = role_tables(spark, SF001)
    ids = t.events.where(~F.col("is_completed")).select("id").limit(5)
    done = C.complete(t.events, ids)
    assert done.count() == t.events.count()
    assert done.where(~F.col("is_completed")).count() == t.events.where(~F.col("is_completed")).count() - 5
    gone = C.deleted_keys(t.plant_changes)
    kept = C.cascade_delete({"m": t.measurements}, gone)["m"]
    assert kept.join(gone.withColumnRenamed("id", "plant_id"), "plant_id").count() == 0


def test_pages_cover_the_list_and_seek_matches_offset(spark):
    t = role_tables(spark, SF001)
    ev = t.events.select("id", "event_date")
    order = [F.col("event_date").desc(), F.col("id").desc()]
    n = ev.count()
    pages = [page(ev, order, p, 20).collect() for p in range(0, n // 20 + 3)]
    flat = [r.id for p in pages[1:] for r in p]  # page 0 is clamped to page 1
    assert [r.id for r in pages[0]] == [r.id for r in pages[1]]
    assert sorted(flat) == sorted(r.id for r in ev.collect()) and pages[-1] == []
    last = None
    for p in range(1, 4):
        seek = page_after(ev, ["event_date", "id"], last, 20).collect()
        assert [r.id for r in seek] == [r.id for r in pages[p]]
        last = (seek[-1].event_date, seek[-1].id)


def test_parse_and_format(spark):
    df = spark.createDataFrame([("2024-03-05 14:07",), ("bad",)], "s string")
    rows = df.select(parse_form_datetime("s").alias("t")).select("t", format_date("t", with_time=True).alias("f")).collect()
    assert rows[0].t == D(2024, 3, 5, 14, 7) and rows[0].f == "05.03.2024 14:07"
    assert rows[1].t is None


def test_scd2_invariants(spark):
    t = role_tables(spark, SF001)
    v = TM.scd2_build(t.plant_changes)
    assert v.where(F.col("valid_from") > F.col("valid_to")).count() == 0
    w = Window.partitionBy("id").orderBy("valid_from", "seq")
    gaps = v.withColumn("_next_from", F.lead("valid_from").over(w)).where(F.col("valid_to") > F.col("_next_from"))
    assert gaps.count() == 0  # versions of a key never overlap
    for at in ["1996-01-01 00:00:00", "1998-01-01 00:00:00", "2001-06-01 00:00:00"]:
        snap = TM.as_of_lookup(v, at)
        assert snap.groupBy("id").count().where("count > 1").count() == 0


def test_scd2_delete_and_reinsert(spark):
    rows = [
        (1, "a", None, None, "L1", None, True, None, None, "INSERT", "u", D(2024, 1, 1), 1),
        (1, "a", None, None, "L2", None, True, None, None, "UPDATE", "u", D(2024, 1, 3), 2),
        (1, "a", None, None, "L2", None, True, None, None, "DELETE", "u", D(2024, 1, 5), 3),
        (1, "a", None, None, "L3", None, True, None, None, "INSERT", "u", D(2024, 1, 9), 4),
        (2, "b", None, None, "X", None, True, None, None, "INSERT", "u", D(2024, 1, 2), 5),
        (2, "b", None, None, "Y", None, True, None, None, "UPDATE", "u", D(2024, 1, 2), 6),
    ]
    ch = spark.createDataFrame(rows, schemas.PLANT_CHANGES)
    v = TM.scd2_build(ch)
    at = {r.id: r.location for r in TM.as_of_lookup(v, "2024-01-06 00:00:00").collect()}
    assert at == {2: "Y"}  # plant 1 deleted between 5th and 9th; equal-time update wins by seq
    assert {r.location for r in TM.as_of_lookup(v, "2024-01-10 00:00:00").where("id = 1").collect()} == {"L3"}
    audit = {r.seq: (r.operation_type, r.location, r.valid_to) for r in TM.audit_rows(ch).collect()}
    assert audit[2] == ("UPDATE", "L1", D(2024, 1, 3)) and audit[3] == ("DELETE", "L2", D(2024, 1, 5))
    snap = {r.id: r.location for r in C.apply_changes(spark.createDataFrame([], schemas.PLANTS), ch).collect()}
    assert snap == {1: "L3", 2: "Y"}


def test_quarantine_split(spark):
    t = role_tables(spark, SF001)
    req = t.measurements.select(F.col("id").alias("request_id"), "plant_id", "height_cm", "width_cm", "leaf_count",
                                "flower_count", (F.col("leaf_count") % 7).alias("health_status"))
    good, bad = Q.quarantine(req, Q.measurement_rules())
    assert good.count() + bad.count() == req.count()
    reasons = bad.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    per_rule = {r.reason: r.n for r in reasons.collect()}
    assert bad.where(F.size("reasons") == 0).count() == 0 < bad.count()
    health = F.col("leaf_count") % 7
    assert per_rule["range:health_status"] == req.where((health < 1) | (health > 5)).count()
    for r in Q.measurement_rules():
        assert per_rule.get(f"{r.rule}:{r.column}", 0) == req.where(r.violates).count()


def test_sql_surface_and_lookup(spark, demo):
    from tendril.operators.paging import lookup_keys
    from tendril.plans.sql import register_views

    names = register_views(spark, demo, "2024-07-01 00:00:00")
    assert "v_growth_statistics" in names
    rows = spark.sql("SELECT plant_id, total_measurements FROM v_growth_statistics ORDER BY plant_id").collect()
    assert [(r.plant_id, r.total_measurements) for r in rows] == [(1, 6), (2, 6), (3, 4)]
    found, missing = lookup_keys(demo.plants, spark.createDataFrame([(1,), (7,)], "id long"))
    assert [r.id for r in found.collect()] == [1] and [r.id for r in missing.collect()] == [7]


def test_apply_change_batches_equals_one_shot(spark):
    t = role_tables(spark, SF001)
    ch = t.plant_changes
    years = [r.y for r in ch.select(F.year("changed_at").alias("y")).distinct().orderBy("y").collect()]
    batches = [ch.where(F.year("changed_at") == y) for y in years]
    stepwise = C.apply_change_batches(t.plants, batches, name=f"snap-{os.getpid()}")
    once = C.apply_changes(t.plants, ch)
    assert stepwise.count() == once.count()
    assert stepwise.exceptAll(once.select(*stepwise.columns)).count() == 0


def test_storage_layout_prunes_months_and_keeps_results(spark, scratch):
    from tendril.plans import views as V
    from tendril.sources.layout import write_tables
    from tests.plan_tools import plan_text

    t = role_tables(spark, SF001)
    write_tables(t, f"{scratch}/lay", files_per_month=2)
    b = load_tables(spark, f"{scratch}/lay")
    assert "_month" in b.measurements.columns
    trend = __import__("tendril.plans.analytics", fromlist=["x"]).measurement_trend
    x = trend(b, "2024-02-15 00:00:00")
    assert "PartitionFilters: [isnotnull(_month" in plan_text(x)
    pairs = [
        (x, trend(t, "2024-02-15 00:00:00")),
        (V.growth_statistics(b, "2024-02-15 00:00:00"), V.growth_statistics(t, "2024-02-15 00:00:00")),
        (V.events_detailed(b, "2001-06-01 00:00:00"), V.events_detailed(t, "2001-06-01 00:00:00")),
    ]
    for got, exp in pairs:
        assert got.count() == exp.count() and got.exceptAll(exp).count() == 0


def test_job_runner_over_stored_tables(spark, scratch):
    from tendril.jobs import run
    from tendril.plans import views as V
    from tendril.sources.layout import write_tables

    t = role_tables(spark, SF001)
    write_tables(t, f"{scratch}/store", files_per_month=2)
    run(spark, "growth_statistics", f"{scratch}/store", f"{scratch}/out", "2024-02-15 00:00:00")
    got = spark.read.parquet(f"{scratch}/out")
    exp = V.growth_statistics(t, "2024-02-15 00:00:00")
    assert got.count() == exp.count() and got.exceptAll(exp.select(*got.columns)).count() == 0


def test_bucketed_tables_join_and_aggregate_without_shuffle(spark):
    import re

    from tendril.plans import views as V
    from tendril.sources.layout import load_catalog, save_bucketed
    from tests.plan_tools import plan_text

    t = role_tables(spark, SF001)
    db = f"care_{os.getpid()}"
    save_bucketed(t, db, 8)
    b = load_catalog(spark, db)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the plan a large plants table gets
    try:
        for fn, at in [(V.growth_statistics, "2024-02-15 00:00:00"), (V.events_detailed, "2001-06-01 00:00:00")]:
            got = fn(b, at)
            assert not re.search(r"Exchange hashpartitioning", plan_text(got, "simple"))
            exp = fn(t, at)
            assert got.count() == exp.count() and got.exceptAll(exp).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bucketing_is_refused_for_a_hot_plant(spark):
    from tendril.sources.layout import load_catalog, save_bucketed
    from tendril.sources.tables import CareTables

    t = role_tables(spark, SF001)
    hot = t.measurements.withColumn("plant_id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("plant_id")))
    skewed = CareTables(t.plant_types, t.plants, t.event_types, t.events, t.reminders, hot, t.plant_images)
    db = f"care_hot_{os.getpid()}"
    flags = save_bucketed(skewed, db, 8)
    assert flags["measurements"] is False and flags["events"] is True
    assert load_catalog(spark, db).measurements.count() == hot.count()


def _nullable(spark):
    import datetime as dt

    days = [dt.datetime(2024, 1, d) for d in (1, 2, 2, 3, 5, 5)]
    rows = [(i, d) for i, d in enumerate([*days, None, None, None])]
    return spark.createDataFrame(rows, "id long, measurement_date timestamp_ntz")


def test_seek_pages_with_null_keys_are_the_whole_list(spark):
    from tendril.operators.paging import seek_order

    df = _nullable(spark)
    for descending in (True, False):
        want = [tuple(r) for r in df.orderBy(*seek_order(["measurement_date", "id"], descending)).collect()]
        got, last = [], None
        while rows := page_after(df, ["measurement_date", "id"], last, 2, descending).collect():
            got += [tuple(r) for r in rows]
            last = (rows[-1].measurement_date, rows[-1].id)
        assert got == want and len(got) == 9


def test_page_totals(spark):
    from tendril.operators.paging import page_totals

    row = page_totals(_nullable(spark), 2, 4).first()
    assert (row.page, row.pages, row.total, row.has_prev, row.has_next) == (2, 3, 9, True, True)
    assert not page_totals(_nullable(spark), 3, 4).first().has_next
    assert page_totals(_nullable(spark).limit(0), 1, 4).first().pages == 0


def test_rule_5_without_its_type_writes_no_event(spark):
    from dataclasses import replace

    from tendril.plans import rules as R
    from tendril.registry_temporal import _measurement_requests
    from tendril.sources.roles import MEASURE_AS_OF, role_tables
    from tests.conftest import SF001

    t = role_tables(spark, SF001)
    bare = replace(t, event_types=t.event_types.where("name <> 'MEASURE'"), _dims={}) if hasattr(t, "_dims") else None
    bare = bare or replace(t, event_types=t.event_types.where("name <> 'MEASURE'"))
    got = R.record_measurements(_measurement_requests(t), bare, MEASURE_AS_OF)
    assert got["events"].count() == 0 and got["measurements"].count() > 0
    both = R.record_measurements(_measurement_requests(t), t, MEASURE_AS_OF, with_rule_1=True)
    types = {r.name: r.default_reminder_days for r in t.event_types.collect()}
    assert (both["reminders"].count() > 0) == (types["MEASURE"] > 0)


def test_match_flag_is_split_under_skew(spark):
    from pyspark.sql import functions as F

    from tendril.plans.quality import with_match_flag
    from tests.plan_tools import plan_text

    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    df = spark.range(0, 200_000, numPartitions=8).select("id", F.when(F.col("id") % 10 < 9, 7).otherwise(F.col("id")).alias("k"))
    parents = spark.range(0, 100_000).repartition(8)
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = with_match_flag(df, "k", parents, "id", "ok", unique=True)
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        assert "skew=true" in plan_text(out, "simple")
        assert out.where("ok").count() == df.where("k < 100000").count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_table_changes_and_ids_of_new_rows(spark):
    import datetime as dt

    from tendril.plans.changes import apply_table_changes
    from tendril.plans.rules import table_rows

    D = dt.datetime
    table = spark.createDataFrame(
        [(1, "a", 1, D(2024, 1, 1), D(2024, 1, 1)), (2, "b", 2, D(2024, 1, 1), D(2024, 1, 1)), (3, "c", 3, None, None)],
        "id long, name string, n int, created_at timestamp_ntz, updated_at timestamp_ntz",
    )
    changes = spark.createDataFrame(
        [
            (1, "x", "UPDATE", D(2024, 2, 1), 1),
            (1, None, "UPDATE", D(2024, 2, 1), 2),
            (2, "y", "UPDATE", D(2024, 2, 3), 3),
            (2, None, "DELETE", D(2024, 2, 4), 4),
            (9, "new", "INSERT", D(2024, 2, 5), 5),
        ],
        "id long, name string, operation_type string, changed_at timestamp_ntz, seq long",
    )
    got = {r.id: tuple(r)[1:] for r in apply_table_changes(table, changes).collect()}
    assert got == {
        1: (None, 1, D(2024, 1, 1), D(2024, 2, 1)),
        3: ("c", 3, None, None),
        9: ("new", None, D(2024, 2, 5), D(2024, 2, 5)),
    }
    made = spark.createDataFrame([(0, "p"), (4, "q")], "source_event_id long, name string")
    first, second = (table_rows(made, table, "source_event_id", 2, slot) for slot in (0, 1))
    ids = [r.id for r in table.unionByName(first).unionByName(second).collect()]
    assert len(ids) == len(set(ids)) == 7 and min(set(ids) - {1, 2, 3}) > 3
