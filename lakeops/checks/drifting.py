"""Drift and alerting."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeops.checks.base import SPLIT, Tables, query, r6, scratch_folder, ts
from lakeops.checks.profiling import FEATURE_NAMES, FEATURES, features, profile_sql
from lakeops.functions import rules
from lakeops.operators import alerts, drift, events, profile, reconcile
from lakeops.plans.monitoring import prediction_drift_alerts
from lakeops.plans.snapshots import current_state, store_snapshot
from lakeops.sources.tables import conform_events

# ---- stand-ins: daily baseline runs, per-user drift, yearly feature baselines -------------------

HISTORY_SQL = f"""daily AS (SELECT date_trunc('day', ts) AS day, floor(value / 20) AS prediction_value, count(*) AS n
  FROM events WHERE ts < TIMESTAMP '{SPLIT}' GROUP BY 1, 2), history AS (SELECT 'clf' AS model_name, 'v1' AS model_version,
  CAST(day AS TIMESTAMP) AS event_timestamp, CAST(CAST(day AS DATE) AS VARCHAR) AS run_id, prediction_value, n AS prediction_count,
  n / sum(n) OVER (PARTITION BY day) AS prediction_rate FROM daily)"""
LATEST_SQL = """latest AS (SELECT * FROM history QUALIFY row_number() OVER (
  PARTITION BY model_name, model_version, prediction_value ORDER BY event_timestamp DESC, run_id DESC) = 1)"""
CURRENT_SQL = f"""current AS (SELECT floor(value / 20) AS prediction_value, count(*) AS n,
  count(*) / (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '{SPLIT}') AS rate
  FROM events WHERE ts >= TIMESTAMP '{SPLIT}' GROUP BY 1)"""
USERS_SQL = f"""users AS (SELECT 'clf' || (user_id % 5) AS model_name, CASE WHEN user_id % 3 > 0 THEN 'v' || (user_id % 3) END AS model_version,
  'r1' AS run_id, 'event_count' AS metric_name, CAST(user_id AS VARCHAR) AS entity_name,
  CAST(nullif(count(*) FILTER (ts < TIMESTAMP '2024-01-16'), 0) AS DOUBLE) AS baseline_value,
  CAST(count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS DOUBLE) AS current_value FROM events GROUP BY user_id)"""
DIFF_SQL = """abs(current_value - baseline_value) AS absolute_diff,
  CASE WHEN baseline_value = 0 THEN abs(current_value - baseline_value) ELSE abs(current_value - baseline_value) / abs(baseline_value) END AS relative_diff"""
STATUS_SQL = """CASE WHEN baseline_value IS NULL THEN 'BASELINE_MISSING' WHEN relative_diff IS NULL OR relative_diff < 0.10 THEN 'OK'
  WHEN relative_diff < 0.30 THEN 'WARNING' ELSE 'CRITICAL' END"""
DRIFTED_SQL = f"""diffs AS (SELECT *, {DIFF_SQL} FROM users), drifted AS (SELECT *, {STATUS_SQL} AS drift_status FROM diffs)"""
SEVERITY_SQL = "CASE WHEN upper(trim(drift_status)) IN ('OK', 'WARNING', 'CRITICAL') THEN upper(trim(drift_status)) ELSE 'OK' END"
MESSAGE_SQL = """'Alerta de modelo: model_name=' || model_name || ', model_version=' || coalesce(model_version, 'None') || ', metric_name=' || metric_name
  || CASE WHEN entity_name <> '' THEN ', entity_name=' || entity_name ELSE '' END || ', severity=' || severity
  || ', baseline_value=' || coalesce(CAST(baseline_value AS VARCHAR), 'None') || ', current_value=' || coalesce(CAST(current_value AS VARCHAR), 'None')"""
ALERTS_SQL = f"""graded AS (SELECT *, {SEVERITY_SQL} AS severity FROM drifted),
  alerted AS (SELECT *, {MESSAGE_SQL} AS message FROM graded WHERE severity IN ('WARNING', 'CRITICAL'))"""


def value_bucket():
    return F.floor(F.col("value") / 20).cast("double")


def prediction_history(t: Tables) -> DataFrame:
    day = F.date_trunc("day", "ts")
    counted = (
        t.events.filter(F.col("ts") < ts(SPLIT))
        .groupBy(day.cast("timestamp_ntz").alias("event_timestamp"), value_bucket().alias("prediction_value"))
        .agg(F.count(F.lit(1)).alias("prediction_count"))
    )
    total = F.sum("prediction_count").over(Window.partitionBy("event_timestamp"))
    return counted.select(
        F.lit("clf").alias("model_name"),
        F.lit("v1").alias("model_version"),
        "event_timestamp",
        F.to_date("event_timestamp").cast("string").alias("run_id"),
        "prediction_value",
        "prediction_count",
        (F.col("prediction_count") / total).alias("prediction_rate"),
    )


def current_predictions(t: Tables) -> DataFrame:
    return t.events.filter(F.col("ts") >= ts(SPLIT)).select(value_bucket().alias("prediction"))


def user_drift(t: Tables) -> DataFrame:
    split = ts("2024-01-16")
    user = F.col("user_id")
    return t.events.groupBy("user_id").agg(
        F.nullif(F.count(F.when(F.col("ts") < split, 1)), F.lit(0)).cast("double").alias("baseline_value"),
        F.count(F.when(F.col("ts") >= split, 1)).cast("double").alias("current_value"),
    ).select(
        F.concat(F.lit("clf"), user % 5).alias("model_name"),
        F.when(user % 3 > 0, F.concat(F.lit("v"), user % 3)).alias("model_version"),
        F.lit("r1").alias("run_id"),
        F.lit("event_count").alias("metric_name"),
        user.cast("string").alias("entity_name"),
        "baseline_value",
        "current_value",
    )


def drifted(t: Tables) -> DataFrame:
    return drift.with_drift(user_drift(t))


def alerted(t: Tables) -> DataFrame:
    return alerts.alerts_from_drift(drifted(t))


FEATURE_RUNS = (("1997-01-01", "r1997"), ("1999-01-01", "r1999"))


def feature_history(t: Tables) -> DataFrame:
    """Two baseline runs: the later one saw more rows but not ``l_partkey``."""
    runs = []
    for cut, run in FEATURE_RUNS:
        names = [n for n in FEATURE_NAMES if run == "r1997" or n != "l_partkey"]
        rows = profile.feature_baseline(features(t).filter(F.col("l_shipdate") < ts(cut)), names)
        runs.append(
            events.event_rows(rows, ts(cut), "dev", "demo", model_name="clf", model_version="v1", run_id=run)
        )
    return profile.union_all(runs)


FEATURE_HISTORY_SQL = "history AS (" + " UNION ALL ".join(
    f"SELECT *, 'clf' AS model_name, 'v1' AS model_version, TIMESTAMP '{cut}' AS event_timestamp, '{run}' AS run_id FROM "
    f"({profile_sql(True, True, f'l_shipdate < TIMESTAMP {chr(39)}{cut}{chr(39)}', rounded=False)})"
    + (" WHERE feature_name <> 'l_partkey'" if run == "r1999" else "")
    for cut, run in FEATURE_RUNS
) + ")"
FEATURE_LATEST_SQL = """latest AS (SELECT * FROM history QUALIFY row_number() OVER (
  PARTITION BY model_name, model_version, feature_name ORDER BY event_timestamp DESC, run_id DESC) = 1)"""

# ---- D ------------------------------------------------------------------------------------------


@query("d1_relative_diff", f"WITH {USERS_SQL}, diffs AS (SELECT *, {DIFF_SQL} FROM users) "
       "SELECT entity_name, round(absolute_diff, 6) AS absolute_diff, round(relative_diff, 6) AS relative_diff FROM diffs")  # fmt: skip
def d1(t: Tables) -> DataFrame:
    return user_drift(t).select(
        "entity_name",
        r6(rules.absolute_diff("baseline_value", "current_value"), "absolute_diff"),
        r6(rules.relative_diff("baseline_value", "current_value"), "relative_diff"),
    )


@query("d2_classify", f"WITH {USERS_SQL}, diffs AS (SELECT *, {DIFF_SQL} FROM users) SELECT entity_name, "
       "CASE WHEN relative_diff IS NULL OR relative_diff < 0.2 THEN 'OK' WHEN relative_diff < 0.5 THEN 'WARNING' ELSE 'CRITICAL' END AS level FROM diffs")  # fmt: skip
def d2(t: Tables) -> DataFrame:
    relative = rules.relative_diff("baseline_value", "current_value")
    return user_drift(t).select("entity_name", rules.classify_drift(relative, 0.2, 0.5).alias("level"))


@query("d3_drift_status", f"WITH {USERS_SQL}, {DRIFTED_SQL} SELECT entity_name, drift_status FROM drifted")
def d3(t: Tables) -> DataFrame:
    return drifted(t).select("entity_name", "drift_status")


@query("d4_latest_prediction_baseline", f"WITH {HISTORY_SQL}, {LATEST_SQL} SELECT model_name, model_version, prediction_value, "
       "run_id, round(prediction_rate, 6) AS prediction_rate FROM latest")  # fmt: skip
def d4(t: Tables) -> DataFrame:
    rows = drift.latest_prediction_baseline(prediction_history(t))
    return rows.select("model_name", "model_version", "prediction_value", "run_id", r6("prediction_rate"))


@query("d5_latest_feature_baseline", f"WITH {FEATURE_HISTORY_SQL}, {FEATURE_LATEST_SQL} SELECT feature_name, run_id, "
       "round(null_rate, 6) AS null_rate, distinct_count, round(mean_value, 5) AS mean_value FROM latest")  # fmt: skip
def d5(t: Tables) -> DataFrame:
    rows = drift.latest_feature_baseline(feature_history(t))
    return rows.select("feature_name", "run_id", r6("null_rate"), "distinct_count", F.round("mean_value", 5).alias("mean_value"))


def _feature_drift_sql(null_safe: bool) -> str:
    numeric = ", ".join(f"'{f[0]}'" for f in FEATURES if f[3])
    body = profile_sql(null_safe, False, "l_shipdate >= TIMESTAMP '1999-01-01'", rounded=False)
    metrics = " UNION ALL ".join(
        f"SELECT c.feature_name AS entity_name, '{m}' AS metric_name, CAST(b.{m} AS DOUBLE) AS baseline_value, "
        f"CAST(c.{m} AS DOUBLE) AS current_value FROM current c LEFT JOIN latest b USING (feature_name)"
        + (f" WHERE c.feature_name IN ({numeric})" if m == "mean_value" else "")
        for m in ("null_rate", "distinct_count", "mean_value")
    )
    return f"""WITH {FEATURE_HISTORY_SQL}, {FEATURE_LATEST_SQL}, current AS ({body}), metrics AS ({metrics}),
      diffs AS (SELECT *, {DIFF_SQL} FROM metrics)
      SELECT entity_name, metric_name, round(baseline_value, 4) AS baseline_value, round(current_value, 4) AS current_value,
      round(relative_diff, 4) AS relative_diff, {STATUS_SQL} AS drift_status FROM diffs"""


def _feature_drift(t: Tables, null_safe: bool) -> DataFrame:
    current = features(t).filter(F.col("l_shipdate") >= ts("1999-01-01"))
    rows = drift.feature_drift(current, FEATURE_NAMES, feature_history(t), "clf", "v1", null_safe_distinct=null_safe)
    rounded = [(F.round(c, 4) + 0.0).alias(c) for c in ("baseline_value", "current_value", "relative_diff")]
    return rows.select("entity_name", "metric_name", *rounded, "drift_status")


@query("d6_feature_drift", _feature_drift_sql(False))
def d6(t: Tables) -> DataFrame:
    return _feature_drift(t, False)


@query("d6_feature_drift_null_safe", _feature_drift_sql(True))
def d6_null_safe(t: Tables) -> DataFrame:
    return _feature_drift(t, True)


PREDICTION_DRIFT_SQL = f"""WITH {HISTORY_SQL}, {LATEST_SQL}, {CURRENT_SQL},
  joined AS (SELECT coalesce(CAST(c.prediction_value AS VARCHAR), 'None') AS entity_name, l.prediction_rate AS baseline_value, c.rate AS current_value
    FROM current c LEFT JOIN latest l ON c.prediction_value IS NOT DISTINCT FROM l.prediction_value),
  diffs AS (SELECT *, {DIFF_SQL} FROM joined)
  SELECT entity_name, round(baseline_value, 6) AS baseline_value, round(current_value, 6) AS current_value,
  round(absolute_diff, 6) AS absolute_diff, round(relative_diff, 6) AS relative_diff, {STATUS_SQL} AS drift_status FROM diffs"""


def _prediction_drift(t: Tables, **options) -> DataFrame:
    rows = drift.prediction_drift(current_predictions(t), prediction_history(t), "clf", "v1", **options)
    numbers = [r6(c) for c in ("baseline_value", "current_value", "absolute_diff", "relative_diff")]
    return rows.select("entity_name", *numbers, "drift_status")


@query("d7_prediction_drift", PREDICTION_DRIFT_SQL)
def d7(t: Tables) -> DataFrame:
    return _prediction_drift(t)


@query(
    "d7_prediction_drift_vanished",
    PREDICTION_DRIFT_SQL.replace("coalesce(CAST(c.prediction_value AS VARCHAR), 'None')", "CAST(coalesce(c.prediction_value, l.prediction_value) AS VARCHAR)")
    .replace("c.rate AS current_value", "coalesce(c.rate, 0) AS current_value")
    .replace("LEFT JOIN latest", "FULL JOIN latest"),
)
def d7_vanished(t: Tables) -> DataFrame:
    return _prediction_drift(t, include_vanished=True)


@query(
    "d8_drift_with_alerts",
    PREDICTION_DRIFT_SQL.replace("SELECT entity_name, round(baseline_value", "SELECT 'drift' AS kind, entity_name, round(baseline_value")
    .replace(", round(absolute_diff, 6) AS absolute_diff, round(relative_diff, 6) AS relative_diff", "")
    .replace("round(current_value, 6) AS current_value,\n  round(absolute_diff, 6) AS absolute_diff, round(relative_diff, 6) AS relative_diff,", "round(current_value, 6) AS current_value,")
    + " UNION ALL SELECT 'alert', entity_name, round(baseline_value, 6), round(current_value, 6), "
    + STATUS_SQL + " AS s FROM diffs WHERE " + STATUS_SQL + " IN ('WARNING', 'CRITICAL')",
)
def d8(t: Tables) -> DataFrame:
    rows, raised = prediction_drift_alerts(
        current_predictions(t), prediction_history(t), ts("2024-02-01"), "dev", "demo", "clf", "v1", "prd", "r1"
    )
    stored = conform_events(rows, "tb_model_drift_monitoring")
    events_stored = conform_events(raised, "tb_ml_alert_events")
    numbers = [r6("baseline_value"), r6("current_value")]
    return stored.select(F.lit("drift").alias("kind"), "entity_name", *numbers, "drift_status").unionByName(
        events_stored.select(F.lit("alert").alias("kind"), "entity_name", *numbers, F.col("severity").alias("drift_status"))
    )


@query(
    "j3_metrics_with_baseline",
    f"WITH {HISTORY_SQL}, {LATEST_SQL}, {CURRENT_SQL} SELECT c.prediction_value, c.n AS prediction_count, "
    "round(l.prediction_rate, 6) AS baseline_rate FROM current c LEFT JOIN latest l ON c.prediction_value IS NOT DISTINCT FROM l.prediction_value",
)
def j3(t: Tables) -> DataFrame:
    base = drift.latest_prediction_baseline(prediction_history(t)).select(
        "prediction_value", F.col("prediction_rate").alias("baseline_rate")
    )
    current = profile.prediction_distribution(current_predictions(t))
    rows = reconcile.with_baseline(current, base, ["prediction_value"])
    return rows.select("prediction_value", "prediction_count", r6("baseline_rate"))


# ---- L ------------------------------------------------------------------------------------------

RAW_STATUS_SQL = """raw AS (SELECT event_id, CASE event_type WHEN 'view' THEN ' critical' WHEN 'click' THEN 'Warning ' WHEN 'error' THEN 'BASELINE_MISSING'
  WHEN 'signup' THEN 'ok' END AS drift_status FROM events)"""


def raw_statuses(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", " critical").when(kind == "click", "Warning ").when(kind == "error", "BASELINE_MISSING").when(kind == "signup", "ok")
    )
    return t.events.select("event_id", status.alias("drift_status"))


@query("l1_severity", f"WITH {RAW_STATUS_SQL} SELECT event_id, {SEVERITY_SQL} AS severity FROM raw")
def l1(t: Tables) -> DataFrame:
    return raw_statuses(t).select("event_id", rules.severity("drift_status").alias("severity"))


@query("l2_minimum_severity", f"WITH {RAW_STATUS_SQL} SELECT event_id FROM raw WHERE {SEVERITY_SQL} IN ('WARNING', 'CRITICAL')")
def l2(t: Tables) -> DataFrame:
    return alerts.keep_alerting(raw_statuses(t), "unknown").select("event_id")


@query("l3_alert_message", f"WITH {USERS_SQL}, {DRIFTED_SQL}, graded AS (SELECT *, {SEVERITY_SQL} AS severity FROM drifted) "
       f"SELECT entity_name, {MESSAGE_SQL} AS message FROM graded")  # fmt: skip
def l3(t: Tables) -> DataFrame:
    text = alerts.alert_message(
        "model_name", "model_version", "metric_name", "entity_name", rules.severity("drift_status"), "baseline_value", "current_value"
    )
    return drifted(t).select("entity_name", text.alias("message"))


@query("l4_alerts_from_drift", f"WITH {USERS_SQL}, {DRIFTED_SQL}, {ALERTS_SQL} SELECT model_name, model_version, run_id, "
       "'drift_monitoring' AS source_component, metric_name, entity_name, baseline_value, current_value, severity, message, "
       "'PENDING' AS notification_status FROM alerted")  # fmt: skip
def l4(t: Tables) -> DataFrame:
    return alerted(t).drop("notification_error")


PLAN_CONFIG = alerts.AlertingConfig(
    email_enabled=True, slack_enabled=True, recipients="a@test.com, b@test.com ,, c@test.com ", slack_webhook_key="hook"
)


@query("l5_notification_plan", f"WITH {USERS_SQL}, {DRIFTED_SQL}, {ALERTS_SQL}, channels AS (SELECT * FROM (VALUES "
       "('email', 'a@test.com;b@test.com;c@test.com'), ('slack', NULL)) v(channel, recipients)) "
       "SELECT a.entity_name, c.channel, c.recipients, CASE WHEN channel = 'email' THEN '[' || severity || '] ' || model_name || ' - ' || metric_name END AS subject, "
       "CASE WHEN channel = 'slack' THEN 'hook' END AS webhook_key, CASE WHEN channel = 'email' THEN message END AS body FROM alerted a, channels c")  # fmt: skip
def l5(t: Tables) -> DataFrame:
    planned = alerts.plan_notifications(alerted(t), PLAN_CONFIG)
    entries = planned.select("entity_name", F.explode("notification_plan").alias("p"))
    return entries.select(
        "entity_name", "p.channel", F.array_join("p.recipients", ";").alias("recipients"), "p.subject", "p.webhook_key", "p.body"
    )


@query("l6_planning_status", """SELECT event_id, CASE WHEN event_type = 'view' THEN 'SKIPPED'
  WHEN event_type = 'click' AND trim(replace(CASE WHEN value > 10 THEN ' , ' ELSE ' x@y.z,' END, ',', '')) = '' THEN 'NO_CHANNEL'
  WHEN event_type IN ('click', 'error') THEN 'PLANNED' ELSE 'NO_CHANNEL' END AS status FROM events""")  # fmt: skip
def l6(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    people = F.when(F.col("value") > 10, " , ").otherwise(" x@y.z,")
    plan = alerts.notification_plan(
        kind == "click", kind == "error", F.lit(False), people, F.lit("s"), F.lit("m"), F.lit("k"), F.lit("k")
    )
    return t.events.select("event_id", alerts.planning_status(kind != "view", plan).alias("status"))


QUEUE_SQL = """queue AS (SELECT CAST(user_id AS VARCHAR) AS entity_name, ts AS event_timestamp,
  CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'PLANNED' WHEN 'error' THEN 'FAILED' ELSE 'SENT' END AS notification_status, event_id FROM events)"""


def queue(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "PENDING").when(kind == "click", "PLANNED").when(kind == "error", "FAILED").otherwise("SENT")
    return t.events.select(
        F.col("user_id").cast("string").alias("entity_name"), F.col("ts").alias("event_timestamp"), status.alias("notification_status"), "event_id"
    )


@query("l7_queue", f"WITH {QUEUE_SQL}, folded AS (SELECT * FROM queue QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY event_timestamp DESC) = 1) "
       "SELECT entity_name, event_timestamp, event_id FROM folded WHERE notification_status = 'PENDING'")  # fmt: skip
def l7(t: Tables) -> DataFrame:
    return alerts.alerts_with_status(queue(t), "PENDING", ["entity_name"]).select("entity_name", "event_timestamp", "event_id")


@query("l7_snapshot_tail", f"WITH {QUEUE_SQL}, folded AS (SELECT * FROM queue QUALIFY row_number() OVER (PARTITION BY entity_name ORDER BY event_timestamp DESC) = 1) "
       "SELECT entity_name, event_timestamp, event_id FROM folded WHERE notification_status = 'PENDING'")  # fmt: skip
def l7_snapshot(t: Tables) -> DataFrame:
    """The queue from a stored snapshot of the first half of January and the events from a day before its end on."""
    path = f"{scratch_folder(t.spark)}/queue-{uuid.uuid4().hex}"
    rows, order, late = queue(t), events.newest("event_timestamp"), timedelta(days=1)
    store_snapshot(rows, path, ["entity_name"], order, datetime(2024, 1, 16), lateness=late)
    newest = current_state(rows, path, ["entity_name"], order, lateness=late)
    return alerts.alerts_with_status(newest, "PENDING", None).select("entity_name", "event_timestamp", "event_id")


@query("l7_queue_as_stored", f"WITH {QUEUE_SQL} SELECT entity_name, event_timestamp, event_id FROM queue WHERE notification_status = 'PENDING'")
def l7_stored(t: Tables) -> DataFrame:
    return alerts.alerts_with_status(queue(t), "PENDING", None).select("entity_name", "event_timestamp", "event_id")


@query("l8_delivery_outcome", """WITH alerts AS (SELECT o_orderkey AS alert_id, CASE WHEN o_orderstatus = 'P' THEN 'SKIPPED' ELSE 'PLANNED' END AS notification_status FROM orders),
  deliveries AS (SELECT l_orderkey AS alert_id, CASE l_linenumber % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'slack' ELSE 'teams' END AS channel,
    CASE WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'DELIVERED' END AS delivery_status,
    CASE WHEN l_returnflag = 'R' THEN 'refused ' || l_linestatus END AS delivery_error, l_shipdate AS delivered_at FROM lineitem),
  last AS (SELECT * FROM deliveries QUALIFY row_number() OVER (PARTITION BY alert_id, channel
    ORDER BY delivered_at DESC, delivery_status DESC, delivery_error DESC NULLS LAST) = 1),
  folded AS (SELECT alert_id, max(delivery_status = 'FAILED') AS failed, string_agg(delivery_error, ' | ' ORDER BY channel) AS errors FROM last GROUP BY 1)
  SELECT a.alert_id, CASE WHEN notification_status <> 'PLANNED' THEN notification_status WHEN failed IS NULL THEN 'PLANNED' WHEN failed THEN 'FAILED' ELSE 'SENT' END AS notification_status,
  CASE WHEN notification_status = 'PLANNED' THEN errors END AS notification_error FROM alerts a LEFT JOIN folded f USING (alert_id)""")  # fmt: skip
def l8(t: Tables) -> DataFrame:
    channel = F.col("l_linenumber") % 3
    failed = F.col("l_returnflag") == "R"
    pending = t.orders.select(
        F.col("o_orderkey").alias("alert_id"),
        F.when(F.col("o_orderstatus") == "P", "SKIPPED").otherwise("PLANNED").alias("notification_status"),
    )
    deliveries = t.lineitem.select(
        F.col("l_orderkey").alias("alert_id"),
        F.when(channel == 0, "email").when(channel == 1, "slack").otherwise("teams").alias("channel"),
        F.when(failed, "FAILED").otherwise("DELIVERED").alias("delivery_status"),
        F.when(failed, F.concat(F.lit("refused "), "l_linestatus")).alias("delivery_error"),
        F.col("l_shipdate").alias("delivered_at"),
    )
    return alerts.delivery_outcomes(pending, deliveries, ["alert_id"])


@query("l9_alert_rules", f"""WITH {USERS_SQL}, diffs AS (SELECT *, {DIFF_SQL} FROM users),
  rules AS (SELECT DISTINCT 'clf' || (user_id % 5) AS model_name, 'event_count' AS metric_name, user_id % 5 <> 1 AS is_enabled,
    CASE WHEN user_id % 5 = 2 THEN 'CRITICAL' ELSE 'WARNING' END AS severity_min, CASE WHEN user_id % 5 = 3 THEN 0.5 END AS threshold_warning,
    CASE WHEN user_id % 5 = 3 THEN 0.9 END AS threshold_critical FROM events WHERE user_id % 5 < 4),
  judged AS (SELECT d.*, r.severity_min, CASE WHEN baseline_value IS NULL THEN 'BASELINE_MISSING' WHEN relative_diff IS NULL OR relative_diff < coalesce(threshold_warning, 0.1) THEN 'OK'
    WHEN relative_diff < coalesce(threshold_critical, 0.3) THEN 'WARNING' ELSE 'CRITICAL' END AS drift_status
    FROM diffs d LEFT JOIN rules r USING (model_name, metric_name) WHERE coalesce(is_enabled, true))
  SELECT model_name, entity_name, drift_status FROM judged WHERE drift_status = 'CRITICAL' OR (drift_status = 'WARNING' AND coalesce(severity_min, 'WARNING') = 'WARNING')""")  # fmt: skip
def l9(t: Tables) -> DataFrame:
    kind = F.col("user_id") % 5
    table = t.events.filter(kind < 4).select(
        F.concat(F.lit("clf"), kind).alias("model_name"),
        F.lit("event_count").alias("metric_name"),
        (kind != 1).alias("is_enabled"),
        F.when(kind == 2, "CRITICAL").otherwise("WARNING").alias("severity_min"),
        F.when(kind == 3, 0.5).alias("threshold_warning"),
        F.when(kind == 3, 0.9).alias("threshold_critical"),
    ).distinct()
    return alerts.apply_alert_rules(drifted(t), table).select("model_name", "entity_name", "drift_status")
