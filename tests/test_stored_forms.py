"""Ranked lists, trigram search, snapshot differences, mergeable states, one-scan quarantine."""

import random

import pytest
from pyspark.sql import functions as F

from tendril.operators import trigrams
from tendril.operators.ranking import PLACE, dense_table_rows, ranked
from tendril.operators.trigrams import build_index, search
from tendril.plans import changes as C
from tendril.plans import quality as Q
from tendril.plans import temporal as TM
from tendril.plans import views as V
from tendril.plans.diff import changes_of, snapshot_diff
from tendril.plans.growth_state import GrowthStates, growth_state, stats_of
from tendril.sources.roles import MEASURE_AS_OF, role_tables
from tests.conftest import SF001
from tests.plan_tools import plan_text


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0


def test_ranked_list_pages_and_numbers(spark):
    rows = [(i, None if i % 7 == 0 else (i * 37) % 50) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(5)
    listed = ranked(df, [F.col("v").desc_nulls_first(), F.col("id").desc()], part_rows=60)
    want = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), -r[0]))
    assert len(listed.parts) > 5 and listed.total == 500
    for page in (0, 1, 2, 13, 25, 26):
        got = sorted((r[PLACE], r.id) for r in listed.page(page, 20).collect())
        first = (max(page, 1) - 1) * 20
        assert got == [(first + k + 1, r[0]) for k, r in enumerate(want[first : first + 20])]
    deep = listed.page(20, 20)
    assert "PartitionFilters: [isnotnull(_part" in plan_text(deep) or "PartitionFilters: [_part" in plan_text(deep)
    assert len([x for x in listed.parts if x[1] < 400 and x[1] + x[2] > 380]) < len(listed.parts)
    got = {r.id: r.nr for r in listed.numbered("nr", 1000).collect()}
    assert got == {r[0]: 1001 + k for k, r in enumerate(want)}
    assert "SinglePartition" not in plan_text(listed.numbered("nr"))
    empty = ranked(df.limit(0), [F.col("id")])
    assert empty.page(1, 20).count() == 0 == empty.numbered("nr").count()


def test_dense_ids_follow_the_table(spark):
    table = spark.createDataFrame([(5, "a"), (9, "b")], "id long, name string")
    made = spark.range(40).select((F.col("id") * 3).alias("source"), F.lit("new").alias("name"))
    got = sorted(map(tuple, dense_table_rows(made, table, [F.col("source")], 7).collect()))
    assert got == [(10 + k, "new") for k in range(40)]


def test_trigram_search_equals_like(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcé%_\\x ") for _ in range(n))
    texts = [(i, rnd.choice([None, word(rnd.randrange(0, 12))])) for i in range(300)] + [(7, "twice"), (7, "twice")]
    needles = [(word(n),) for n in (0, 1, 1, 2, 2, 3, 3, 4, 5) for _ in range(4)] + [("abc",), (None,), ("%",), ("_",), ("zzz",)]
    t = spark.createDataFrame(texts, "id long, name string")
    n = spark.createDataFrame(needles, "needle string")
    index = build_index(t, "id", "name")
    got = search(index, t, "id", "name", n)
    pattern = F.concat(F.lit("%"), F.replace("needle", F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    want = t.crossJoin(n.distinct()).where(F.like("name", pattern)).select("needle", "id").distinct()
    assert same(got.distinct(), want) and want.count() > 100
    plan = plan_text(got)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert search(index, t, "id", "name", n.limit(0)).count() == 0


def test_trigram_index_is_cut_in_parts_and_stays_in_place(spark, monkeypatch):
    t = spark.range(400).select("id", F.concat(F.lit("Plant é#"), "id").alias("name")).coalesce(1)
    monkeypatch.setattr(trigrams, "PART_CHARS", 1000)
    index = build_index(t, "id", "name")
    per_file = index.postings.where("gram = 'Pla'").groupBy(F.input_file_name()).count()
    assert per_file.count() > 1 and per_file.agg(F.max("count")).first()[0] < 200
    want = {r.gram: r.n for r in index.postings.groupBy("gram").agg(F.count("*").alias("n")).collect()}
    assert {r.gram: r.n for r in index.counts.collect()} == want and want[""] == want["é#"] == 400
    got = search(index, t, "id", "name", spark.createDataFrame([("#39",), ("é#7",), ("",)], "needle string"))
    assert got.count() == 11 + 11 + 400
    assert "hashpartitioning(gram" not in plan_text(got, "simple")


def test_diff_applied_to_the_old_snapshot_gives_the_new_one(spark):
    t = role_tables(spark, SF001)
    old = t.plants.where("id % 11 <> 0")
    new = t.plants.where("id % 13 <> 0").withColumn("location", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("location")))
    diff = snapshot_diff(old, new)
    ops = {r.operation_type: r.n for r in diff.groupBy("operation_type").agg(F.count("*").alias("n")).collect()}
    changed = new.where("id % 5 = 0 AND id % 11 <> 0").join(t.plants.where("location IS NOT NULL").select("id"), "id")
    assert ops == {"INSERT": new.where("id % 11 = 0").count(), "DELETE": old.where("id % 13 = 0").count(), "UPDATE": changed.count()}
    assert same(C.apply_table_changes(old, changes_of(diff, "2024-01-01 00:00:00")), new)
    assert snapshot_diff(old, old).count() == 0
    assert plan_text(diff, "simple").count("Exchange hashpartitioning") <= 2
    versions = TM.scd2_build(changes_of(diff, "2024-01-01 00:00:00"))
    assert versions.count() == ops["INSERT"] + ops["UPDATE"]


def test_states_of_batches_merge_and_forget(spark, scratch):
    t = role_tables(spark, SF001)
    m = t.measurements
    states = GrowthStates(spark, f"{scratch}/states", MEASURE_AS_OF, buckets=4)
    schema = growth_state(m, MEASURE_AS_OF).schema
    for k in range(3):
        states.add(m.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k), k)
    states.add(m.where(F.pmod(F.xxhash64("id"), F.lit(3)) == 2), 2)  # the batch runs again
    assert same(V.growth_statistics(t, MEASURE_AS_OF, stats=stats_of(states.state(schema))), V.growth_statistics(t, MEASURE_AS_OF))
    gone = (F.col("plant_id") == 5) | (F.col("id") % 10 == 0)
    states.rebuild(m.where(gone).select("plant_id"), m.where(~gone | gone.isNull()), 3)
    want = growth_state(m.where(~gone | gone.isNull()), MEASURE_AS_OF)
    got = states.state(schema)
    assert same(got.select(want.columns), want) and got.where("plant_id = 5").count() == 0


def test_quarantine_in_one_scan(spark, scratch):
    t = role_tables(spark, SF001)
    rules = Q.measurement_rules()
    counts = Q.write_quarantined(t.measurements, rules, f"{scratch}/q")
    good, bad = Q.quarantine(t.measurements, rules)
    written = spark.read.parquet(f"{scratch}/q")
    columns = t.measurements.columns
    assert same(written.where("rejected = 'false'").select(columns), good.select(columns))
    assert same(written.where("rejected = 'true'").select(*columns, "reasons"), bad.select(*columns, "reasons"))
    assert counts["rows"] == t.measurements.count() and counts["rejected"] == bad.count()
    for r in rules:
        assert counts[f"{r.rule}:{r.column}"] == t.measurements.where(r.violates).count()


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_quarantine_of_few_rows(spark, scratch, rows):
    df = spark.createDataFrame(rows, "id long, v int")
    counts = Q.write_quarantined(df, [Q.in_range("v", 1, 5)], f"{scratch}/few")
    assert counts == {"rows": len(rows), "rejected": 0, "range:v": 0}
