"""Decisions made and carried out once, and current state from snapshots."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakeops.operators.events import latest_by, newest
from lakeops.plans import journal, lifecycle
from lakeops.plans.snapshots import current_state, newest_snapshot, store_snapshot
from lakeops.sources.tables import append_events
from tests.test_lifecycle import deployments, registry, requests

TABLES = ("tb_model_registry", "tb_model_deployments", "tb_ml_governance_runs")


def stored(spark):
    schema = f"journal_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE SCHEMA {schema}")
    append_events(registry(spark, [("v1", "TRAINED", "path/v1", 1), ("v2", "TRAINED", "path/v2", 2)]), TABLES[0], f"{schema}.{TABLES[0]}")
    history = [("v1", "hml", "DEPLOYED_HML", True, 1), ("v1", "hml", "INACTIVE", False, 2), ("v2", "hml", "DEPLOYED_HML", True, 3)]
    append_events(deployments(spark, history), TABLES[1], f"{schema}.{TABLES[1]}")
    return schema


def rows_of(spark, schema):
    names = [t for t in TABLES if spark.catalog.tableExists(f"{schema}.{t}")]
    return {name: sorted(map(str, spark.table(f"{schema}.{name}").collect())) for name in names}


def run(spark, schema, folder, *asked, day=9):
    return lifecycle.run_rollbacks(spark, schema, requests(spark, *asked), F.lit(datetime(2024, 1, day)), "dev", "demo", f"{schema}.plan", folder)


@pytest.mark.parametrize("stop", [None, "plan", "keys", "bloom", "commits", 0, 1, 2])
def test_a_stopped_job_that_is_repeated_ends_like_one_run(spark, tmp_path, monkeypatch, stop):
    asked = [("m", "hml", "g1"), ("m", "prd", "g2")]
    clean, schema = stored(spark), stored(spark)
    run(spark, clean, str(tmp_path / "clean"), *asked)
    folder = str(tmp_path / "journal")
    if stop is not None:
        writer = type(requests(spark, *asked).write)
        whole, append, calls = writer.parquet, journal.append_table, []

        def parquet(self, target, *args, **kwargs):
            whole(self, target, *args, **kwargs)
            if isinstance(stop, str) and f"/{stop}" in target:
                raise RuntimeError("stopped")

        def append_table(*args, **kwargs):
            append(*args, **kwargs)
            calls.append(1)
            if len(calls) - 1 == stop:
                raise RuntimeError("stopped")

        monkeypatch.setattr(writer, "parquet", parquet)
        monkeypatch.setattr(journal, "append_table", append_table)
        with pytest.raises(RuntimeError, match="stopped"):
            run(spark, schema, folder, *asked)
        monkeypatch.undo()
    plan = run(spark, schema, folder, *asked)
    assert {(r.run_id, r.to_version, r.reason) for r in plan.collect()} == {("g1", "v1", None), ("g2", None, "NO_ACTIVE_DEPLOYMENT")}
    again = run(spark, schema, folder, *asked, day=20)
    assert again.count() == 2 and rows_of(spark, schema) == rows_of(spark, clean)
    assert run(spark, schema, folder, ("m", "hml", "g3"), day=21).first().to_version == "v2"


def test_only_parts_that_a_filter_names_are_read(spark, tmp_path):
    path, keys = str(tmp_path / "journal"), ["k", "v"]
    first = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, "x").alias("v"))
    decide = lambda asked: asked.withColumn("answer", F.lit(1))
    derive = lambda plan: {"events": plan.select("k")}
    assert journal.named_parts(first, path, keys) == []
    plan, events = journal.decide_once(first, path, keys, decide, derive)
    assert plan.count() == 2000 and events["events"].count() == 2000
    few = first.filter("k < 3")
    parts = journal.named_parts(few, path, keys)
    assert {r.p for r in few.select(journal.part_of(keys).alias("p")).collect()} == set(parts)
    known = journal.answered(few, path, keys)
    assert known.count() == 3
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    scans = known._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1:]
    assert "part" in plan and any(all(str(p) in scan.split("]")[0] for p in parts) for scan in scans)
    fresh = spark.range(10_000, 12_000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    assert len(journal.named_parts(fresh, path, keys)) < 20
    both, _ = journal.decide_once(few.unionByName(fresh), path, keys, decide, derive)
    assert both.count() == 2003
    assert spark.read.parquet(f"{path}/rows/plan").count() == 4000


def test_requests_are_read_twice_at_most_where_a_journal_exists(spark, tmp_path):
    schema, folder, reads = stored(spark), str(tmp_path / "journal"), spark.sparkContext.accumulator(0)
    asked = [(f"m{i}", "hml", f"g{i}") for i in range(40)]
    run(spark, schema, folder, ("m", "hml", "g"), *asked[:20])

    def read(row):
        reads.add(1)
        return row

    counted = spark.createDataFrame(spark.sparkContext.parallelize([("m", "hml", "g"), *asked], 2).map(read), requests(spark, *asked).schema)
    plan = lifecycle.run_rollbacks(spark, schema, counted, F.lit(datetime(2024, 1, 9)), "dev", "demo", f"{schema}.plan", folder)
    assert reads.value <= 2 * 41
    assert plan.count() == 41 and plan.filter("reason IS NULL").count() == 1
    assert spark.table(f"{schema}.{TABLES[2]}").count() == 2 * 41


def test_a_batch_with_a_filter_of_another_layout_still_answers(spark, tmp_path):
    path, keys = str(tmp_path / "journal"), ["k", "v"]
    first = spark.range(30).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, "x").alias("v"))
    decide = lambda asked: asked.withColumn("answer", F.lit(1))
    derive = lambda plan: {"events": plan.select("k")}
    decide(first).write.parquet(f"{path}/rows/plan/batch=old")
    first.select("k").write.parquet(f"{path}/rows/events/batch=old")
    first.withColumn("part", journal.part_of(keys)).write.partitionBy("part").parquet(f"{path}/keys/batch=old")
    spark.createDataFrame([("old",)], "batch STRING").write.parquet(f"{path}/commits")
    more = first.unionByName(spark.range(30, 40).select(F.col("id").alias("k"), F.lit("x").alias("v")))
    for count in (40, 40):
        plan, events = journal.decide_once(more, path, keys, decide, derive)
        assert plan.count() == count and events["events"].count() == count
    assert spark.read.parquet(f"{path}/rows/plan").count() == 40


def test_a_key_takes_one_row_of_a_filter(spark):
    rows = spark.range(3000).select(F.col("id").alias("k"))
    masks = journal.with_mask(rows, ["k"])
    assert masks.count() == 3000
    bits = {r.n: r["count"] for r in masks.groupBy(F.bit_count("mask").alias("n")).count().collect()}
    assert set(bits) <= set(range(1, journal.PROBES + 1)) and bits[journal.PROBES] > 2000
    assert journal.filter_rows(rows, ["k"]).join(masks, ["part", "word"]).count() == 3000


def test_a_snapshot_and_its_tail_give_the_whole_fold(spark, tmp_path):
    path, order = str(tmp_path / "state"), newest("event_timestamp", "id")
    start = datetime(2024, 1, 1)
    kind = "k int, id int, event_timestamp timestamp, v string"
    events = spark.createDataFrame([(i % 7, i, start + timedelta(hours=i), f"v{i}") for i in range(200)], kind)
    source = str(tmp_path / "events")
    events.repartition(4).write.parquet(source)
    stored_events = spark.read.parquet(source)
    whole = {tuple(r) for r in latest_by(stored_events, ["k"], order).collect()}
    assert newest_snapshot(stored_events, path) is None
    assert {tuple(r) for r in current_state(stored_events, path, ["k"], order).collect()} == whole
    assert [store_snapshot(stored_events, path, ["k"], order, start + timedelta(hours=h)) for h in (50, 120)] == [0, 1]
    state = current_state(stored_events, path, ["k"], order)
    assert {tuple(r) for r in state.collect()} == whole
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_timestamp,2024-01-06" in plan
    late = spark.createDataFrame([(3, 999, start + timedelta(hours=119), "late"), (50, 998, start + timedelta(hours=3), "older")], kind)
    more = stored_events.unionByName(late)
    seen = {r.k for r in current_state(more, path, ["k"], order, lateness=timedelta(hours=2)).collect()}
    assert 50 not in seen and 3 in seen
    store_snapshot(more, path, ["k"], order, start + timedelta(hours=120), whole=True)
    assert {tuple(r) for r in current_state(more, path, ["k"], order).collect()} == {tuple(r) for r in latest_by(more, ["k"], order).collect()}
    with pytest.raises(ValueError, match="is stored"):
        store_snapshot(events, path, ["k"], order, start)
