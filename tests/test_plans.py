"""Whole jobs: layers, drift with alerts, training and scoring, documents, streaming, governance."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from lakeops.operators import clean, datasets, governance
from lakeops.operators.alerts import AlertingConfig, alerts_with_status, apply_alert_rules, delivery_outcomes
from lakeops.operators.drift import prediction_drift
from lakeops.operators.events import event_rows, newest
from lakeops.operators.policy import Policy
from lakeops.operators.retrieval import QUERY_COLUMNS
from lakeops.operators.reconcile import with_baseline
from lakeops.operators.runs import catalog_inventory, readiness_report, run_summary
from lakeops.plans.evaluation import store_evaluation
from lakeops.plans.notifications import plan_pending, record_outcomes
from lakeops.plans.documents import Stages, run_documents, table_writer
from lakeops.plans.medallion import run_layers
from lakeops.plans.monitoring import prediction_drift_alerts, store_drift
from lakeops.plans.training import train_and_score
from lakeops.session import checkpoint_root
from lakeops.sources.tables import append_events
from lakeops.streaming import ingest
from lakeops.streaming.ingest import append_new_chunks, document_chunks, hash_prefix, stored_hashes, stream_new_chunks

NOW = datetime(2024, 2, 1)


@pytest.fixture()
def schema(spark):
    name = f"p_{uuid.uuid4().hex[:10]}"
    spark.sql(f"CREATE SCHEMA {name}")
    return name


def test_layers(spark, schema):
    feed = spark.createDataFrame([(1, " Ana ", "pf", "ativo"), (2, "Bruno", "PJ", "INATIVO"), (3, "Carla", "PF", "ATIVO")], "id_cliente bigint, nome string, segmento string, status string")
    gold = run_layers(spark, feed, schema, NOW)
    assert gold.columns == list(clean.GOLD_COLUMNS)
    assert sorted((r.id_cliente, r.nome, r.segmento) for r in gold.collect()) == [(1, "Ana", "PF"), (3, "Carla", "PF")]
    assert run_layers(spark, feed.filter("id_cliente = 1"), schema, NOW).count() == 1


def test_window_bounds(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-03",)], "d string")
    assert [r.d for r in clean.time_window(df, "d", "2024-01-02", "2024-01-03").collect()] == ["2024-01-02"]
    assert clean.time_window(df, "d", "", None).count() == 3
    assert clean.time_window(df.withColumn("t", F.to_timestamp("d")), "t", None, "2024-01-02").count() == 1


def test_window_reaches_the_scan(spark):
    df = clean.time_window(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), "l_shipdate", "1997-01-01", "1999-01-01").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    assert "l_extendedprice" not in plan


def test_bad_number_is_an_error(spark):
    df = spark.createDataFrame([("x", 1)], "prediction string, label int")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        clean.numeric_pair(df).collect()


def test_store_drift(spark, schema):
    base = event_rows(
        spark.createDataFrame([(1.0, 0.5), (0.0, 0.5)], "prediction_value double, prediction_rate double"), NOW, "dev", "demo", model_name="m", model_version="v", run_id="b"
    )
    current = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (2.0,)], "prediction double")
    drift, alerts = prediction_drift_alerts(current, base, NOW, "dev", "demo", "m", "v", "prd", "r1")
    assert alerts.count() == 1
    for run, at in (("r1", NOW), ("r2", datetime(2024, 2, 2)), ("r1", NOW), ("r2", datetime(2024, 2, 3))):
        rows = drift.withColumns({"run_id": F.lit(run), "event_timestamp": F.lit(at)})
        store_drift(rows, at, "dev", "demo", "m", run, drift_table=f"{schema}.drift", alert_table=f"{schema}.alerts")
    stored = spark.table(f"{schema}.drift").groupBy("run_id").count().collect()
    assert {r.run_id: r["count"] for r in stored} == {"r1": drift.count(), "r2": drift.count()}
    rows = spark.table(f"{schema}.alerts").collect()
    assert sorted((r.run_id, r.severity, r.entity_name) for r in rows) == [("r1", "CRITICAL", "1.0"), ("r2", "CRITICAL", "1.0")]
    assert prediction_drift(current, base, "m", "v").count() == 2


def customers(spark):
    rows = [(i % 40, "PF" if i % 3 else "PJ", "file" if i % 2 else "table", "ATIVO" if i % 40 < 25 else "INATIVO", i) for i in range(400)]
    return spark.createDataFrame(rows, "id_cliente bigint, segmento string, source_type string, status string, ts int")


def test_consolidate_and_survivors(spark):
    rows = [(1, "PF", "file", "INATIVO", 1), (1, "PJ", "file", "ATIVO", 2), (2, "PF", "api", "INATIVO", 1), (2, "PF", "file", "INATIVO", 9)]
    df = spark.createDataFrame(rows, "id_cliente bigint, segmento string, source_type string, status string, ts int")
    got = {r.id_cliente: r for r in datasets.consolidate(df).collect()}
    assert (got[1].segmento_dominante, got[1].status_final, got[1].tem_file, got[1].tem_table) == ("PF", "ATIVO", 1, 0)
    assert got[2].qtd_registros == 2
    kept = {r.id_cliente: (r.source_type, r.ts) for r in datasets.survivorship(df, newest("ts")).collect()}
    assert kept == {1: ("file", 2), 2: ("file", 9)}
    split = datasets.with_split(spark.createDataFrame([(0,), (1,), (3,), (-3,)], "id_cliente bigint"))
    assert {r.id_cliente: r.dataset_split for r in split.collect()} == {0: "test", 1: "train", 3: "test", -3: "test"}


def test_train_score_and_reuse(spark, schema, tmp_path):
    base = str(tmp_path)
    run = train_and_score(spark, customers(spark), schema, "clf", "v1", "r1", NOW, "dev", "demo", base_path=base)
    assert run.predictions.count() == 40
    metrics = {r.metric_name: r.metric_value for r in run.metrics.collect()}
    test = run.predictions.filter("dataset_split = 'test'")
    assert metrics["f1"] == pytest.approx(MulticlassClassificationEvaluator(metricName="f1").evaluate(test), abs=1e-12)
    assert {r.status for r in spark.table(f"{schema}.tb_ml_smoke_runs").collect()} == {"STARTED", "SUCCESS"}
    columns = ["id_cliente", "prediction", "score"]
    before = sorted(map(tuple, run.predictions.select(*columns).collect()))
    again = train_and_score(spark, customers(spark), schema, "clf", "v1", "r2", NOW, "dev", "demo", skip_train=True, base_path=base)
    assert sorted(map(tuple, again.predictions.select(*columns).collect())) == before
    with pytest.raises(ValueError, match="model version"):
        train_and_score(spark, customers(spark), schema, "clf", None, "r3", NOW, "dev", "demo", skip_train=True)


def knowledge(spark):
    rows = [(f"d{i}", "pt" if i % 2 else "en", " ".join(f"palavra{j * (i + 1)}" for j in range(60))) for i in range(6)]
    return spark.createDataFrame(rows, "document_id string, lang string, document_text string")


def test_document_stages(spark, schema):
    none = run_documents(knowledge(spark), Stages(), "m")
    assert none.chunks is None and none.report("lang").first().status == "FAILED"
    assert run_documents(knowledge(spark), Stages(embeddings=True), "m").embeddings is None
    chunked = run_documents(knowledge(spark), Stages(True, True, True), "m", size=120, overlap=20)
    questions = chunked.index.filter("position = 0") if "position" in chunked.index.columns else chunked.index
    questions = questions.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"), "document_id")
    write = table_writer(schema, "demo")
    full = run_documents(knowledge(spark), Stages(True, True, True, True), "m", size=120, overlap=20, questions=questions, write=write)
    assert spark.table(f"{schema}.tb_demo_ai_index").count() == full.index.count()
    assert full.rag_eval.filter("hit = 0").count() == 0
    report = full.report("lang").collect()
    assert all(r.chunks_count == r.embeddings_count == r.index_count > 0 for r in report)
    assert len(QUERY_COLUMNS) == 8


def test_store_of_another_shape_is_an_error(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.range(3).withColumn("batch", F.lit(0)).write.parquet(path)
    chunks = document_chunks(knowledge(spark), "document_text", ["document_id"], 120, 20)
    with pytest.raises(AnalysisException):
        append_new_chunks(chunks, path, 1)


def test_null_meets_its_baseline(spark):
    current = spark.createDataFrame([(1.0, 5), (None, 2), (3.0, 1)], "v double, n int")
    base = spark.createDataFrame([(None, 0.4), (1.0, 0.6)], "v double, rate double")
    rows = with_baseline(current, base, ["v"])
    assert rows.columns == ["v", "n", "rate"]
    assert {tuple(r) for r in rows.collect()} == {(1.0, 5, 0.6), (None, 2, 0.4), (3.0, 1, None)}


def test_repeated_rules_judge_once(spark):
    drift = spark.createDataFrame([("m", "f", 1.0, 0.2)], "model_name string, metric_name string, baseline_value double, relative_diff double").withColumn("drift_status", F.lit("OK"))
    kind = "model_name string, metric_name string, is_enabled boolean, severity_min string, threshold_warning double, threshold_critical double"
    rules = spark.createDataFrame([("m", "f", True, "WARNING", 0.1, 0.5), ("m", "f", True, "WARNING", 0.1, 0.15)], kind)
    assert [r.drift_status for r in apply_alert_rules(drift, rules).collect()] == ["WARNING"]


def test_stream_is_incremental(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = knowledge(spark).schema

    def arrive(rows, name):
        rows.coalesce(1).write.mode("append").parquet(source)
        stream_new_chunks(spark, source, schema, target, state, "document_text", ["document_id"], 120, 20)
        return spark.read.parquet(target).count()

    first = arrive(knowledge(spark), "a")
    assert first > 6
    renamed = knowledge(spark).withColumn("document_id", F.concat(F.lit("copy-"), "document_id"))
    assert arrive(renamed, "b") == first
    fresh = spark.createDataFrame([("z", "pt", "um texto novo")], schema)
    assert arrive(fresh, "c") == first + 1
    stored = spark.read.parquet(target)
    assert stored.select("chunk_hash").distinct().count() == stored.count()


def test_stored_hashes_are_pruned_by_prefix(spark, tmp_path):
    path = str(tmp_path / "store")
    chunks = document_chunks(knowledge(spark), "document_text", ["document_id"], 120, 20)
    append_new_chunks(chunks, path, 0)
    some = chunks.limit(2)
    prefixes = [r[0] for r in some.select(hash_prefix(2)).distinct().collect()]
    seen = stored_hashes(spark, path, prefixes, 1)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert all(p in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0] for p in prefixes)
    files = seen.select(F.input_file_name()).distinct().count()
    assert 0 < files <= len(prefixes) < spark.read.parquet(path).select(F.input_file_name()).distinct().count()
    append_new_chunks(chunks, path, 1)
    append_new_chunks(chunks, path, 0)
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("chunk_hash").distinct().count() == chunks.select("chunk_hash").distinct().count()


def test_a_trigger_takes_a_bounded_number_of_files(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = knowledge(spark)
    rows.repartition(3).write.parquet(source)
    stream_new_chunks(spark, source, rows.schema, target, state, "document_text", ["document_id"], 120, 20, files_per_trigger=1)
    stored = spark.read.parquet(target)
    assert stored.select("batch").distinct().count() > 1
    assert stored.count() == document_chunks(rows, "document_text", ["document_id"], 120, 20).select("chunk_hash").distinct().count()


def test_a_stream_reads_a_file_and_a_folder_of_files(spark, tmp_path):
    rows = knowledge(spark)
    folder = str(tmp_path / "tables" / "documents.parquet")
    rows.repartition(3).write.parquet(folder)
    (tmp_path / "single").mkdir()
    part = next((tmp_path / "tables" / "documents.parquet").glob("part-*"))
    file = tmp_path / "single" / "documents.parquet"
    file.write_bytes(part.read_bytes())
    (tmp_path / "single" / "other.parquet").write_bytes(b"not read")
    for source in (folder, str(file)):
        target = str(tmp_path / uuid.uuid4().hex)
        stream_new_chunks(spark, source, rows.schema, f"{target}/out", f"{target}/state", "document_text", ["document_id"], 120, 20)
        wanted = document_chunks(spark.read.parquet(source), "document_text", ["document_id"], 120, 20).select("chunk_hash").distinct()
        assert sorted(spark.read.parquet(f"{target}/out").select("chunk_hash").collect()) == sorted(wanted.collect())


def test_texts_of_a_batch_move_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MANY_COPIES", 1)
    path = str(tmp_path / "store")
    rows = knowledge(spark)
    chunks = document_chunks(rows.unionByName(rows.withColumn("document_id", F.concat(F.lit("copy-"), "document_id"))), "document_text", ["document_id"], 120, 20)
    copied = [c for r in ingest.prefix_copies(chunks, 2).collect() for c in r.copied]
    assert copied and all(c.n > 1 and not c.newest.startswith("copy-") for c in copied)
    append_new_chunks(chunks.filter("position = 0"), path, 0)
    append_new_chunks(chunks, path, 1)
    stored = spark.read.parquet(path)
    newest_ids = chunks.groupBy("chunk_hash").agg(F.max("chunk_id").alias("chunk_id"), F.max("chunk_text_normalized").alias("chunk_text_normalized"))
    assert stored.count() == newest_ids.count()
    fresh = stored.filter("batch = 1").select("chunk_hash", "chunk_id", "chunk_text_normalized")
    assert fresh.count() > 0 and fresh.exceptAll(newest_ids).isEmpty()
    seen = stored_hashes(spark, path, [r[0] for r in chunks.select(hash_prefix(2)).distinct().collect()], 2)
    plan = ingest.placed_chunks(chunks, seen, None, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Join" not in plan


DELIVERY = "a string, b string, channel string, delivered_at int, delivery_status string, delivery_error string"


def test_outcomes_of_odd_deliveries(spark):
    """Keys and channels without a value, attempts that come twice or at the same time, without time, status or error, and
    alerts that come twice or already have an error."""
    alerts = spark.createDataFrame(
        [("x", None, "PLANNED", "old"), ("x", None, "PLANNED", "old"), (None, None, "PLANNED", None), ("y", "1", "SKIPPED", "old"), ("z", "1", "PLANNED", "old"), ("u", "1", "PLANNED", "old"), ("v", "1", "PLANNED", None), ("w", "1", None, "old")],
        "a string, b string, notification_status string, notification_error string",
    )
    deliveries = spark.createDataFrame(
        [
            ("x", None, "slack", 1, "FAILED", "s1"), ("x", None, "slack", 2, "DELIVERED", None), ("x", None, "slack", 2, "FAILED", "s2"), ("x", None, "slack", 2, "FAILED", "s2"),
            ("x", None, "email", None, "DELIVERED", None), ("x", None, "email", 0, "FAILED", "e0"), ("x", None, None, 1, None, "n1"), ("x", None, "teams", 5, "FAILED", ""),
            (None, None, "slack", 1, "FAILED", None), (None, None, "slack", 1, "FAILED", "late"), ("y", "1", "slack", 1, "FAILED", "y"),
            ("u", "1", "slack", 3, "DELIVERED", None), ("u", "1", "slack", 2, "FAILED", "u"), ("v", "1", None, None, None, None), ("w", "1", "slack", 1, "FAILED", "w"), ("q", "1", "slack", 1, "FAILED", "q"),
        ],
        DELIVERY,
    )
    got = sorted(map(str, map(tuple, delivery_outcomes(alerts, deliveries, ["a", "b"]).collect())))
    expected = [
        ("x", None, "FAILED", "n1 | e0 | s2"), ("x", None, "FAILED", "n1 | e0 | s2"), (None, None, "FAILED", "late"), ("y", "1", "SKIPPED", "old"),
        ("z", "1", "PLANNED", "old"), ("u", "1", "SENT", None), ("v", "1", "SENT", None), ("w", "1", None, "old"),
    ]
    assert got == sorted(map(str, expected))


def test_outcomes_shuffle_attempts_as_plain_columns(spark):
    """The newest attempt per channel is taken before its shuffle, and not as a struct."""
    alerts = spark.createDataFrame([("x", "1", "PLANNED")], "a string, b string, notification_status string")
    deliveries = spark.createDataFrame([("x", "1", "slack", 1, "FAILED", "s", "more")], f"{DELIVERY}, answer string")
    lines = delivery_outcomes(alerts, deliveries, ["a", "b"])._jdf.queryExecution().executedPlan().toString().splitlines()
    (at,) = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(" in line and "channel#" in line]
    assert "WindowGroupLimit" in lines[at + 1] and "Partial" in lines[at + 1]
    assert not any("max(struct(" in line for line in lines) and "answer#" not in "".join(lines[: at + 4])


VALID = {
    "spec_id": 1, "catalog_name": None, "schema_name": "clientes_silver", "table_name": "tb_cliente", "table_description": "Tabela",
    "table_properties": governance.DEFAULT_PROPERTIES, "table_tags": {"descricao_tabela": "Tabela", "sla": "N/A"}, "using_format": "delta",
}
SPEC = "spec_id int, catalog_name string, schema_name string, table_name string, table_description string, table_properties map<string,string>, table_tags map<string,string>, using_format string"
COLUMN, TAG = "spec_id int, name string, data_type string, comment string", "spec_id int, column_name string, tags map<string,string>"


def test_valid_spec_has_no_violation(spark):
    tables = spark.createDataFrame([tuple(VALID.values())], SPEC)
    columns = spark.createDataFrame([(1, "id_cliente", "STRING", "Id"), (1, "nome", "STRING", "Nome")], COLUMN)
    tags = spark.createDataFrame([(1, "ID_CLIENTE", {"pii": "não", "classificacao": "interno"}), (1, "nome", {"pii": "sim", "classificacao": "confidencial"})], TAG)
    assert governance.audit_specs(tables, columns, tags).count() == 0
    assert governance.audit_contracts(tables, columns).count() == 0
    bare = tables.withColumn("table_properties", F.lit(None).cast("map<string,string>")).withColumn("table_tags", F.lit(None).cast("map<string,string>"))
    got = {r.rule for r in governance.audit_specs(bare, columns.limit(0), tags).collect()}
    assert got == {"missing_properties", "missing_description_tag", "no_columns", "tags_of_unknown_column"}
    assert {r.rule for r in governance.audit_contracts(bare, columns, defaults={}).collect()} == {"missing_property"}


def test_spec_audit_of_odd_rows(spark):
    """Specifications without a key or named twice, names without text or of other case, repeated rows and tags."""
    specs = [{**VALID, "spec_id": k} for k in (1, 1, 2, 2, None, None, 3)]
    tables = spark.createDataFrame([tuple(s.values()) for s in specs], SPEC)
    columns = spark.createDataFrame(
        [(1, "a", "", None), (1, "a", "", None), (1, "A", "STRING", "x"), (3, None, " ", "x"), (3, "b", "STRING", "x"), (4, "c", "STRING", "x"), (4, " ", None, "x")], COLUMN
    )
    full = {"pii": "sim", "classificacao": "interno"}
    tags = spark.createDataFrame([(1, "a", full), (1, "A", full), (2, "x", {"pii": "sim"}), (2, "X", None), (3, None, full), (None, "c", full)], TAG)
    got = Counter(map(tuple, governance.audit_specs(tables, columns, tags).collect()))
    assert got == Counter(
        {
            (1, "blank_column_type", "a"): 2, (1, "blank_column_comment", "a"): 2, (1, "duplicate_column", "a"): 1,
            (2, "no_columns", ""): 2, (2, "tags_of_unknown_column", "x"): 1,
            (2, "missing_column_tags", "x:classificacao"): 1, (2, "missing_column_tags", "x:classificacao,pii"): 1,
            (None, "no_columns", ""): 2, (None, "tags_of_unknown_column", "c"): 1,
            (3, "blank_column_name", ""): 1, (3, "blank_column_type", None): 1, (3, "column_without_tags", "b"): 1,
            (4, "blank_column_name", ""): 1, (4, "blank_column_type", " "): 1, (4, "column_without_tags", " "): 1, (4, "column_without_tags", "c"): 1,
        }
    )
    assert governance.audit_specs(tables.limit(0), columns.limit(0), tags.limit(0)).count() == 0


def test_spec_audit_shuffles_counts_only(spark):
    """Only counts are grouped, and no explode reads its rows from a lambda, which would be interpreted."""
    tables = spark.createDataFrame([tuple(VALID.values())], SPEC)
    columns = spark.createDataFrame([(1, "nome", "STRING", "Nome")], COLUMN)
    tags = spark.createDataFrame([(1, "nome", {"pii": "sim"})], TAG)
    plan = governance.audit_specs(tables, columns, tags)._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(shuffles) == 2 and not any("rule" in s or "detail" in s for s in shuffles)
    assert plan.count("Generate explode(") == 5 and "Generate explode(filter(" not in plan


def test_masking_depends_on_the_caller(spark):
    df = spark.createDataFrame([("Maria 1", "x@y.z")], "nome string, email string")
    tags = {"nome": {"mascaramento": "mascarado"}, "email": {"mascaramento": "aberto"}}
    assert tuple(governance.mask_columns(df, tags, ["owners"], ["guests"]).first()) == ("Xxxxx n", "x@y.z")
    assert tuple(governance.mask_columns(df, tags, ["owners"], ["owners"]).first()) == ("Maria 1", "x@y.z")


def test_readiness_of_a_catalog(spark, schema):
    spark.range(1).write.saveAsTable(f"{schema}.tb_model_registry")
    row = readiness_report(catalog_inventory(spark, schema)).first()
    assert (row.ready_items, row.total_items, row.readiness_score) == (1, 13, round(1 / 13, 4))
    assert catalog_inventory(spark, "no_such_schema").count() == 0


def test_run_summary(spark):
    rows = [("c", "r1", "STARTED", "x", "2024-01-01 00:00:00"), ("c", "r1", "ERROR", "ValueError: no", "2024-01-01 00:00:02"), ("c", "r2", "STARTED", "x", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "component string, run_id string, status string, message string, at string").withColumn("event_timestamp", F.to_timestamp("at"))
    got = {r.run_id: (r.status, r.message, r.duration_seconds) for r in run_summary(df).collect()}
    assert got == {"r1": ("ERROR", "ValueError: no", 2.0), "r2": ("STARTED", None, None)}


def test_checkpoint_root(spark):
    assert checkpoint_root(spark).endswith("checkpoint")
    assert checkpoint_root(spark, "/elsewhere").endswith("checkpoint")


def test_alert_queue(spark, schema):
    table = f"{schema}.alerts"
    kind = "model_name string, model_version string, run_id string, source_component string, metric_name string, entity_name string, severity string, message string, notification_status string"
    rows = [("m", None, f"r{i}", "drift_monitoring", "f1", None, "CRITICAL", "text", "PENDING") for i in range(3)]
    append_events(event_rows(spark.createDataFrame(rows, kind), datetime(2024, 1, 1), "dev", "demo"), "tb_ml_alert_events", table)
    config = AlertingConfig(email_enabled=True, slack_enabled=True, recipients="a@b.c")
    planned = plan_pending(spark, table, config, NOW, f"{schema}.plan")
    entries = [(f"r{i}", channel) for i in range(3) for channel in ("email", "slack")]
    assert sorted((r.run_id, r.channel) for r in planned.collect()) == sorted(entries)
    assert plan_pending(spark, table, config, NOW, f"{schema}.plan").count() == 6
    assert alerts_with_status(spark.table(table), "PENDING").count() == 0
    sent = [("r0", "email", 1, "DELIVERED", None), ("r0", "slack", 1, "FAILED", "timeout"), ("r0", "slack", 2, "FAILED", "refused"), ("r1", "email", 1, "FAILED", "x"), ("r1", "email", 2, "DELIVERED", None), ("r2", "email", 1, "DELIVERED", None)]
    later = [("r1", "slack", 3, "DELIVERED", None)]
    deliveries = spark.createDataFrame(sent, "run_id string, channel string, delivered_at int, delivery_status string, delivery_error string")
    keys = {"model_name": F.lit("m"), "model_version": F.lit(None).cast("string"), "source_component": F.lit("drift_monitoring"), "metric_name": F.lit("f1"), "entity_name": F.lit(None).cast("string")}
    record_outcomes(spark, table, deliveries.withColumns(keys), NOW, f"{schema}.plan")
    assert sorted(r.run_id for r in alerts_with_status(spark.table(table), "PLANNED").collect()) == ["r1", "r2"]
    both = deliveries.union(spark.createDataFrame(later, deliveries.schema)).withColumns(keys)
    for _ in range(2):
        record_outcomes(spark, table, both, NOW, f"{schema}.plan")
    assert spark.table(table).count() == 3 + 3 + 2
    newest_rows = {s: [r.run_id for r in alerts_with_status(spark.table(table), s).collect()] for s in ("PLANNED", "FAILED", "SENT", "NO_CHANNEL")}
    assert newest_rows == {"PLANNED": ["r2"], "FAILED": ["r0"], "SENT": ["r1"], "NO_CHANNEL": []}
    assert spark.table(table).filter("notification_status = 'FAILED'").first().notification_error == "refused"


def test_store_evaluation(spark, schema):
    metrics = spark.createDataFrame([("f1", 0.61, "a", "b"), ("accuracy", 0.9, "a", "b"), ("support", 10.0, "a", "b")], "metric_name string, metric_value double, window_start string, window_end string")
    policy = Policy({"f1": 0.7, "accuracy": 0.7}, open_on_postprod=True)
    names = {"metrics_table": f"{schema}.metrics", "requests_table": f"{schema}.requests"}
    for _ in range(2):
        store_evaluation(metrics, policy, NOW, "dev", "demo", "m", "v1", "r1", **names)
    assert spark.table(f"{schema}.metrics").count() == 3
    row = spark.table(f"{schema}.requests").collect()
    assert [(r.request_status, r.trigger_type, r.run_id) for r in row] == [("OPEN", "POSTPROD_DEGRADATION", "r1")]
