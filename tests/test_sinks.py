"""Sinks that must not lose or mix up rows, and masking that is closed by default."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from lakeops.operators.governance import mask_by_control
from lakeops.sources import buckets, tables
from lakeops.sources.tables import append_table, upsert_table


def test_partitioned_append_goes_by_name(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS sinks")
    spark.sql("DROP TABLE IF EXISTS sinks.events")
    for note in ("first", "second"):
        append_table(spark.createDataFrame([("d1", "m", note)], "day string, model string, note string"), "sinks.events", ["day"])
    assert {(r.day, r.model, r.note) for r in spark.table("sinks.events").collect()} == {("d1", "m", "first"), ("d1", "m", "second")}


def test_upsert_after_a_stop_between_the_renames(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS sinks")
    for name in ("sinks.target", "sinks.target__merged", "sinks.target__previous"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    upsert_table(spark, "sinks.target", rows((1, "old"), (2, "keep")), ["k"])
    spark.sql("ALTER TABLE sinks.target RENAME TO sinks.target__previous")  # where a stopped call leaves off
    for value in ("a", "b"):
        upsert_table(spark, "sinks.target", rows((1, value)), ["k"])
        assert {(r.k, r.v) for r in spark.table("sinks.target").collect()} == {(1, value), (2, "keep")}


def test_masking_is_closed_by_default(spark):
    schema = "t string, anonimizar boolean, pass_masking boolean, grant_view_dados array<string>"
    control = spark.createDataFrame(
        [("null", True, True, None), ("element", True, True, ["owners", None]), ("granted", True, True, ["me"]),
         ("flag", None, True, []), ("off", False, True, []), ("twice", True, True, ["me"]), ("twice", True, True, [])],
        schema,
    )
    names = ["null", "element", "granted", "flag", "off", "twice", "absent"]
    df = spark.createDataFrame([(n, "value") for n in names], "t string, v string")
    out = {r.t: r.v for r in mask_by_control(df, control, ["t"], ["v"], ["me"]).collect()}
    assert len(out) == len(names) and {n for n, v in out.items() if v == "value"} == {"granted", "off", "absent"}


def test_a_run_replaces_its_own_rows_only(spark):
    name = f"runs_{uuid.uuid4().hex[:8]}"
    rows = lambda *r: spark.createDataFrame(r, "run_id string, id int")
    tables.overwrite_run(rows(("a", 1), ("a", 2)), name, "a")
    tables.overwrite_run(rows(("b", 3)), name, "b")
    tables.overwrite_run(rows(("a", 4)), name, "a")
    assert sorted((r.run_id, r.id) for r in spark.table(name).collect()) == [("a", 4), ("b", 3)]
    spark.sql(f"DROP TABLE {name}")
    tables.overwrite_table(rows(("a", 1)), name)
    with pytest.raises(ValueError, match="not partitioned"):
        tables.overwrite_run(rows(("b", 1)), name, "b")
    spark.sql(f"DROP TABLE {name}")


def parts_of(spark, path):
    rows = buckets.read_buckets(spark, path).withColumn("f", F.input_file_name()).select("f").distinct().collect()
    return {tuple(r.f.split("/")[-3:-1]) for r in rows}


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(200).selectExpr("id AS k", "CAST(id AS STRING) AS v", "'a' AS w")
    buckets.create_buckets(rows, path, ["k"], 8)
    before = parts_of(spark, path)
    one = spark.createDataFrame([(7, "new", "b")], "k long, v string, w string")
    touched = buckets.upsert_buckets(one, path, ["v"])
    after = parts_of(spark, path)
    assert len(touched) == 1 and len(before) == len(after) == 8
    assert after - before == {("generation=1", f"bucket={touched[0]}")} and len(before - after) == 1
    stored = {r.k: (r.v, r.w) for r in buckets.read_buckets(spark, path).collect()}
    assert stored == {i: ("new" if i == 7 else str(i), "a") for i in range(200)}
    assert buckets.upsert_buckets(one.limit(0), path) == []
    nulls = spark.createDataFrame([(None, "n", "n"), (500, "m", "m")], "k long, v string, w string")
    buckets.upsert_buckets(nulls, path)
    assert buckets.read_buckets(spark, path).count() == 202
    plan = buckets.read_buckets(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "generation" in plan.split("PartitionFilters: [")[1]


@pytest.mark.parametrize("step", ["data", "manifest", "commits"])
def test_an_upsert_stopped_after_any_step_loses_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    buckets.create_buckets(rows((1, "a"), (2, "b"), (3, "c")), path, ["k"], 4)
    whole = type(rows((1, "a")).write).parquet

    def stops(writer, target, *args, **kwargs):
        whole(writer, target, *args, **kwargs)
        if f"/{step}" in target:
            raise RuntimeError("stopped")

    monkeypatch.setattr(type(rows((1, "a")).write), "parquet", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        buckets.upsert_buckets(rows((2, "lost"), (4, "d")), path)
    monkeypatch.undo()
    done = step == "commits"
    want = {(1, "a"), (2, "lost"), (3, "c"), (4, "d")} if done else {(1, "a"), (2, "b"), (3, "c")}
    assert {tuple(r) for r in buckets.read_buckets(spark, path).collect()} == want
    buckets.upsert_buckets(rows((2, "new"), (9, "e")), path)
    again = {(k, v) for k, v in want if k != 2} | {(2, "new"), (9, "e")}
    assert {tuple(r) for r in buckets.read_buckets(spark, path).collect()} == again


def test_bucket_tables_are_made_once(spark, tmp_path):
    path = str(tmp_path / "t")
    none = spark.createDataFrame([], "k int, v string")
    with pytest.raises(ValueError, match="no table"):
        buckets.read_buckets(spark, path)
    buckets.create_buckets(none, path, ["k"], 4)
    assert buckets.read_buckets(spark, path).count() == 0
    with pytest.raises(ValueError, match="already"):
        buckets.create_buckets(none, path, ["k"], 4)
    with pytest.raises(ValueError, match="between"):
        buckets.create_buckets(none, path + "x", ["k"], 0)
    buckets.upsert_buckets(spark.createDataFrame([(1, "a")], "k int, v string"), path)
    assert [tuple(r) for r in buckets.read_buckets(spark, path).collect()] == [(1, "a")]
