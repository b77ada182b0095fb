"""Value fixtures of the rule columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakeops.functions import rules
from lakeops.operators import alerts, lifecycle, policy
from lakeops.operators.runs import operational_report, smoke_report


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_relative_diff(spark):
    rows = [(10.0, 12.0), (0.0, 0.25), (None, 1.0), (1.0, None), (-4.0, -2.0)]
    got = values(spark, rows, "b double, c double", rules.absolute_diff("b", "c"), rules.relative_diff("b", "c"))
    assert got == [(2.0, 0.2), (0.25, 0.25), (None, None), (None, None), (2.0, 0.5)]


def test_classify_and_status(spark):
    rows = [(0.05,), (0.15,), (0.35,), (None,), (0.10,), (0.30,), (float("nan"),)]
    got = values(spark, rows, "r double", rules.classify_drift("r"))
    assert [g[0] for g in got] == ["OK", "WARNING", "CRITICAL", "OK", "WARNING", "CRITICAL", "CRITICAL"]
    got = values(spark, [(None, None), (1.0, 0.05)], "b double, r double", rules.drift_status("b", "r"))
    assert got == [("BASELINE_MISSING",), ("OK",)]


def test_severity_minimum(spark):
    rows = [(" critical",), ("Warning ",), ("BASELINE_MISSING",), (None,), ("ok",)]
    df = spark.createDataFrame(rows, "drift_status string")
    assert [r[0] for r in df.select(rules.severity("drift_status")).collect()] == ["CRITICAL", "WARNING", "OK", "OK", "OK"]
    assert alerts.keep_alerting(df, "OK").count() == 5
    assert alerts.keep_alerting(df, "WARNING").count() == 2
    assert alerts.keep_alerting(df, "CRITICAL").count() == 1
    assert alerts.keep_alerting(df, None).count() == 2
    assert alerts.keep_alerting(df, "whatever").count() == 2


def drift_row(status, metric="null_rate", entity="tem_file"):
    return ("clf", None, "r1", metric, entity, 0.5, 0.75, status)


DRIFT = "model_name string, model_version string, run_id string, metric_name string, entity_name string, baseline_value double, current_value double, drift_status string"


def test_alerts_from_drift(spark):
    df = spark.createDataFrame([drift_row("CRITICAL"), drift_row("OK")], DRIFT)
    rows = alerts.alerts_from_drift(df).collect()
    assert len(rows) == 1
    assert (rows[0].severity, rows[0].notification_status, rows[0].source_component) == ("CRITICAL", "PENDING", "drift_monitoring")
    assert rows[0].message == (
        "Alerta de modelo: model_name=clf, model_version=None, metric_name=null_rate, entity_name=tem_file, "
        "severity=CRITICAL, baseline_value=0.5, current_value=0.75"
    )
    both = spark.createDataFrame([drift_row("WARNING", entity=None), drift_row("CRITICAL", entity="")], DRIFT)
    rows = alerts.alerts_from_drift(both).collect()
    assert [r.severity for r in rows] == ["WARNING", "CRITICAL"]
    assert all("entity_name" not in r.message for r in rows)


def test_recipients(spark):
    rows = [("a@test.com, b@test.com ,, c@test.com ",), (None,), ("  ",), (" , ",)]
    got = values(spark, rows, "r string", alerts.clean_recipients("r"))
    assert [g[0] for g in got] == [["a@test.com", "b@test.com", "c@test.com"], [], [], []]


def planned(spark, config):
    df = spark.createDataFrame([("CRITICAL", "clf", "f1", "text")], "severity string, model_name string, metric_name string, message string")
    return alerts.plan_notifications(df, config).first()


def test_plan_channels(spark):
    row = planned(spark, alerts.AlertingConfig(email_enabled=True, slack_enabled=True, recipients="a@b.c"))
    assert [p.channel for p in row.notification_plan] == ["email", "slack"]
    assert row.notification_plan[0].subject == "[CRITICAL] clf - f1"
    assert row.notification_status == "PLANNED"
    row = planned(spark, alerts.AlertingConfig(email_enabled=True, recipients="  "))
    assert (row.notification_plan, row.notification_status) == ([], "NO_CHANNEL")
    row = planned(spark, alerts.AlertingConfig(enable_alerting=False, slack_enabled=True))
    assert row.notification_status == "SKIPPED"


def test_planning_status_without_recipients(spark):
    entry = F.struct(
        F.lit("email").alias("channel"), F.array().cast("array<string>").alias("recipients"), F.lit("s").alias("subject"),
        F.lit("b").alias("body"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("webhook_key"),
    ).cast(alerts.PLAN_TYPE)
    assert spark.range(1).select(alerts.planning_status(F.lit(True), F.array(entry))).first()[0] == "NO_RECIPIENTS"


@pytest.mark.parametrize("score, band", [(0.93, "alto"), (0.21, "baixo"), (0.5, "medio"), (None, None), (0.7, "alto")])
def test_score_band(spark, score, band):
    got = values(spark, [(score,)], "s double", rules.score_band("s", [(0.4, "medio"), (0.7, "alto")], "baixo"))
    assert got == [(band,)]


def test_cycle_key(spark):
    row = ("drift_cycle", "clf", None, "2024-01-01", None, None)
    got = values(spark, [row], "a string, b string, c string, d string, e string, f string", rules.cycle_key("a", "b", "c", "d", "e", "f"))
    assert got == [("drift_cycle|clf||2024-01-01||",)]


def test_transitions(spark):
    rows = [(a, b) for a in policy.REQUEST_STATUSES for b in policy.REQUEST_STATUSES] + [(None, "OPEN")]
    got = values(spark, rows, "a string, b string", "a", "b", F.coalesce(policy.allowed_transition("a", "b"), F.lit(False)))
    assert {(a, b) for a, b, ok in got if ok} == set(policy.TRANSITIONS)


def test_gates(spark):
    df = spark.createDataFrame([(0.81,), (0.61,), (None,)], "f1 double")
    rows = policy.retraining_gate(df, {"f1": 0.70}).collect()
    assert [r.approved for r in rows] == [True, False, False]
    assert rows[0].reason == "f1=0.81 atende threshold=0.7"
    assert rows[2].reason == "f1=None abaixo do threshold=0.7"
    assert all(r.approved for r in policy.retraining_gate(df, {}).collect())
    rollbacks = spark.createDataFrame([("a", "v1"), ("b", None)], "model_name string, model_version string")
    smoke = spark.createDataFrame([("b", None, "SUCCESS"), ("a", "v1", "STARTED")], "model_name string, model_version string, status string")
    got = {r.model_name: r.approved for r in policy.rollback_gate(rollbacks, smoke).collect()}
    assert got == {"a": False, "b": True}
    assert all(r.approved for r in policy.rollback_gate(rollbacks, smoke, require_smoke=False).collect())


def test_cycle_order(spark):
    names = ["drift_cycle", "postprod_cycle", "retraining_cycle", "operational_cycle"]
    rows = [("good", n, i) for i, n in enumerate(names)] + [("good", "drift_cycle", 9)]
    rows += [("bad", n, i) for i, n in enumerate(reversed(names))] + [("short", names[0], 0)]
    rows += [("extra", n, i) for i, n in enumerate([*names, "other"])]
    df = spark.createDataFrame(rows, "batch string, cycle string, at int")
    got = {r.batch: r.is_valid for r in policy.cycle_order_check(df, "batch", "cycle", "at").collect()}
    assert got == {"good": True, "bad": False, "short": False, "extra": False}


def test_requests_from_metrics(spark):
    schema = "model_name string, model_version string, run_id string, metric_name string, metric_value double"
    rows = [("clf", "v1", "r", "f1", 0.61), ("clf", "v1", "r", "accuracy", 0.70), ("clf", "v1", "r", "auc", 0.1), ("clf", "v1", "r", "recall", None)]
    df = spark.createDataFrame(rows, schema)
    opened = policy.requests_from_metrics(df, policy.Policy({"f1": 0.7, "accuracy": 0.7, "recall": 0.7}, open_on_postprod=True)).collect()
    assert [(r.request_status, r.trigger_type, r.reason) for r in opened] == [
        ("OPEN", "POSTPROD_DEGRADATION", "Postprod metric abaixo do threshold: f1=0.61, threshold=0.7")
    ]
    assert policy.requests_from_metrics(df, policy.Policy({"f1": 0.7})).count() == 0
    flagged = policy.rollback_suggestions(df, policy.Policy({"accuracy": 0.75}, suggest_rollback=True))
    assert {r.metric_name for r in flagged.filter("suggest_rollback").collect()} == {"accuracy"}


def test_unknown_trigger_fails(spark):
    df = spark.createDataFrame([("clf", "r")], "model_name string, run_id string")
    with pytest.raises(Exception, match="unknown trigger type"):
        policy.open_requests(df, trigger_type="OTHER", trigger_source="x").collect()


def stage_rows(spark, counts):
    stages = ("knowledge", "chunks", "embeddings", "index", "rag_eval")
    return spark.createDataFrame([("p", s, c) for s, c in zip(stages, counts)], "project string, stage string, row_count bigint")


def test_reports(spark):
    assert smoke_report(stage_rows(spark, (10, 20, 20, 20, 1))).first().status == "SUCCESS"
    row = smoke_report(stage_rows(spark, (10, 20, 0, 0, 0))).first()
    assert (row.status, row.chunks_present, row.index_present) == ("FAILED", True, False)
    row = operational_report(stage_rows(spark, (10, 50, 50, 50, 0))).first()
    assert (row.embedding_coverage, row.status) == (1.0, "OK")
    row = operational_report(stage_rows(spark, (10, 0, 0, 0, 0))).first()
    assert (row.embedding_coverage, row.status) == (0.0, "WARN")


def test_promotion_paths(spark):
    rows = [("dev", "hml"), ("hml", "prd"), ("dev", "prd"), (None, "hml")]
    got = values(spark, rows, "source_env string, target_env string", lifecycle.valid_promotion_path())
    assert [g[0] for g in got] == [True, True, False, False]
