"""Folds, schema enforcement, idempotent appends and merges on real tables."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from lakeops.operators.events import conform, event_rows, latest_by, new_events, newest, upsert
from lakeops.operators.policy import with_cycle_key
from lakeops.sources import tables as tb
from lakeops.sources.schemas import EVENT_FIELDS, alert_rules_schema, event_schema


@pytest.fixture()
def schema(spark):
    name = f"t_{uuid.uuid4().hex[:10]}"
    spark.sql(f"CREATE SCHEMA {name}")
    return name


def test_schemas_parse(spark):
    for table in EVENT_FIELDS:
        fields = event_schema(table).fields
        assert [f.name for f in fields[:3]] == ["event_timestamp", "env", "project"]
        assert not any(f.nullable for f in fields[:3])
    assert [f.name for f in event_schema("tb_model_confusion_matrix").fields][-4:] == ["actual_label", "predicted_label", "record_count", "run_id"]
    assert len(alert_rules_schema().fields) == 14


def registry(spark, rows):
    df = spark.createDataFrame(rows, "model_name string, model_version string, algorithm string, run_id string, status string, artifact_path string, at string")
    return event_rows(df, F.to_timestamp("at"), "dev", "demo")


def test_append_creates_then_appends(spark, schema):
    rows = registry(spark, [("m", "v1", "lr", "r1", "TRAINED", None, "2024-01-01")])
    for _ in range(2):
        tb.append_events(rows, "tb_model_registry", f"{schema}.reg")
    stored = spark.table(f"{schema}.reg")
    assert stored.count() == 2
    assert stored.columns == [f.name for f in event_schema("tb_model_registry").fields]


def test_null_in_required_column_fails(spark, schema):
    rows = registry(spark, [("m", None, "lr", "r1", "TRAINED", None, "2024-01-01")])
    with pytest.raises(Exception, match="NULL in required column model_version"):
        tb.append_events(rows, "tb_model_registry", f"{schema}.bad")
    with pytest.raises(ValueError, match="required column is missing"):
        conform(rows.drop("status"), event_schema("tb_model_registry"))


def test_append_new_is_idempotent(spark, schema):
    rows = registry(
        spark,
        [("m", "v1", "lr", "r1", "TRAINED", None, "2024-01-01"), ("m", "v1", "lr", "r1", "EVALUATED", None, "2024-01-02"), ("m", "v2", "lr", "r2", "TRAINED", None, "2024-01-01")],
    )
    for _ in range(3):
        tb.append_new_events(rows, "tb_model_registry", ["model_name", "model_version"], newest("event_timestamp"), f"{schema}.reg")
    stored = {(r.model_version, r.status) for r in spark.table(f"{schema}.reg").collect()}
    assert stored == {("v1", "EVALUATED"), ("v2", "TRAINED")}
    assert spark.table(f"{schema}.reg").count() == 2


def test_new_events_null_key_and_status(spark):
    kind = "k string, s string, n int"
    incoming = spark.createDataFrame([(None, "x", 1), ("a", "x", 2), ("b", "x", 3)], kind)
    existing = spark.createDataFrame([(None, "SUCCESS", 0), ("a", "ERROR", 0)], kind)
    got = new_events(incoming, existing, ["k"], newest("n"), F.col("s") == "SUCCESS")
    assert {r.k for r in got.collect()} == {"a", "b"}
    assert {r.k for r in new_events(incoming, existing, ["k"], newest("n")).collect()} == {"b"}


def test_latest_by_prunes_before_the_shuffle(spark):
    hot = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("n"))
    folded = latest_by(hot, ["k"], newest("n"))
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert folded.filter("k = 0").first().n == 29_997
    assert folded.count() == 20_001


def test_upsert_semantics(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "n", 0.0)], "k int, name string, v double")
    source = spark.createDataFrame([(2, "B", 20.0), (3, "C", 30.0), (None, "N", 9.0)], "k int, name string, v double")
    got = {(r.k, r.name, r.v) for r in upsert(target, source, ["k"], ["v"]).collect()}
    assert got == {(1, "a", 1.0), (2, "b", 20.0), (None, "n", 0.0), (3, "C", 30.0), (None, "N", 9.0)}
    got = {(r.k, r.name) for r in upsert(target, source, ["k"]).collect()}
    assert (2, "B") in got


def test_upsert_table_swaps(spark, schema):
    name = f"{schema}.control"
    kind = "catalog string, schema string, tabela string, coluna string, anonimizar boolean"
    keys = ["catalog", "schema", "tabela", "coluna"]
    first = spark.createDataFrame([("c", "s", "t", "x", False), ("c", "s", "t", "y", False)], kind)
    second = spark.createDataFrame([("c", "s", "t", "y", True), ("c", "s", "t", "z", True)], kind)
    for rows in (first, second, second):
        tb.upsert_table(spark, name, rows, keys)
    assert {(r.coluna, r.anonimizar) for r in spark.table(name).collect()} == {("x", False), ("y", True), ("z", True)}
    assert {r.tableName for r in spark.sql(f"SHOW TABLES IN {schema}").collect()} == {"control"}


def test_delimited_file(spark, tmp_path):
    path = tmp_path / "clientes.csv"
    path.write_text("id_cliente,nome,segmento,status\n100,Gabi,PF,ATIVO\n101,Heitor,PJ,ATIVO\n102,Iris,PF,INATIVO\n")
    rows = tb.read_delimited(spark, str(path), "id_cliente BIGINT, nome STRING, segmento STRING, status STRING").collect()
    assert [(r.id_cliente, r.nome) for r in rows] == [(100, "Gabi"), (101, "Heitor"), (102, "Iris")]


def test_dataset_versions():
    assert tb.dataset_table("training", "v1", "s") == "s.tb_clientes_training_dataset"
    for purpose, version in (("training", "v9"), ("scoring", "v1")):
        with pytest.raises(ValueError):
            tb.dataset_table(purpose, version)


def test_repeated_cycle_is_dropped(spark):
    kind = "cycle_name string, model_name string, model_version string, window_start string, window_end string, severity string, at int"
    done = with_cycle_key(spark.createDataFrame([("drift_cycle", "m", None, "a", "b", None, 1)], kind))
    asked = with_cycle_key(spark.createDataFrame([("drift_cycle", "m", None, "a", "b", None, 2), ("drift_cycle", "m", "v1", "a", "b", None, 2)], kind))
    fresh = new_events(asked, done, ["execution_key"], newest("at")).collect()
    assert [r.execution_key for r in fresh] == ["drift_cycle|m|v1|a|b|"]
