"""Retraining, gates, cycle order and retention."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.checks.base import Tables, query, scratch_schema, ts
from lakeops.checks.drifting import ALERTS_SQL, DRIFTED_SQL, USERS_SQL, alerted
from lakeops.functions.rules import cycle_key
from lakeops.operators import policy as pl
from lakeops.operators.events import event_rows
from lakeops.plans.retention import append_periods, apply_retention
from lakeops.sources.tables import conform_events

POLICY = pl.Policy(
    pl.DEFAULT_MINIMA, open_on_drift=True, open_on_postprod=True, suggest_rollback=True, approve_drift=True, approve_postprod=False
)

METRICS_SQL = """metrics AS (SELECT 'm' || l_suppkey AS model_name, CASE l_linenumber % 6 WHEN 0 THEN 'accuracy' WHEN 1 THEN 'f1' WHEN 2 THEN 'precision' WHEN 3 THEN 'recall' WHEN 4 THEN 'auc' ELSE 'support' END AS metric_name,
  CASE WHEN l_partkey % 9 > 0 THEN l_partkey % 100 / 100 END AS metric_value, 'r' || l_orderkey AS run_id FROM lineitem)"""


def metric_rows(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("accuracy", "f1", "precision", "recall", "auc", "support")])
    return t.lineitem.select(
        F.concat(F.lit("m"), "l_suppkey").alias("model_name"),
        F.lit(None).cast("string").alias("model_version"),
        F.get(names, F.col("l_linenumber") % 6).alias("metric_name"),
        F.when(F.col("l_partkey") % 9 > 0, F.col("l_partkey") % 100 / 100).alias("metric_value"),
        F.concat(F.lit("r"), "l_orderkey").alias("run_id"),
    )


@query("t1_requests_from_alerts", f"WITH {USERS_SQL}, {DRIFTED_SQL}, {ALERTS_SQL} SELECT model_name, model_version, 'DRIFT' AS trigger_type, 'drift_monitoring' AS trigger_source, "
       "severity AS trigger_severity, message AS reason, 'OPEN' AS request_status, 'mlops' AS requested_by, run_id FROM alerted WHERE severity = 'CRITICAL'")  # fmt: skip
def t1(t: Tables) -> DataFrame:
    return pl.requests_from_alerts(alerted(t), POLICY, "mlops")


MINIMUM_SQL = "metric_name IN ('accuracy', 'f1', 'precision', 'recall') AND metric_value < 0.7"


@query("t2_requests_from_metrics", f"WITH {METRICS_SQL} SELECT model_name, run_id, 'POSTPROD_DEGRADATION' AS trigger_type, 'CRITICAL' AS trigger_severity, 'OPEN' AS request_status, "
       f"'Postprod metric abaixo do threshold: ' || metric_name || '=' || CAST(metric_value AS VARCHAR) || ', threshold=0.7' AS reason FROM metrics WHERE {MINIMUM_SQL}")  # fmt: skip
def t2(t: Tables) -> DataFrame:
    rows = pl.requests_from_metrics(metric_rows(t), POLICY)
    return rows.select("model_name", "run_id", "trigger_type", "trigger_severity", "request_status", "reason")


@query("t3_rollback_suggestion", f"WITH {METRICS_SQL} SELECT model_name, metric_name, run_id, coalesce({MINIMUM_SQL}, false) AS suggest_rollback FROM metrics")
def t3(t: Tables) -> DataFrame:
    return pl.rollback_suggestions(metric_rows(t), POLICY).select("model_name", "metric_name", "run_id", "suggest_rollback")


REQUESTS_SQL = """requests AS (SELECT 'm' || user_id AS model_name, CASE WHEN user_id % 4 > 0 THEN 'v' || (user_id % 4) END AS model_version, 'r' || (event_id % 3) AS run_id,
  CASE event_type WHEN 'view' THEN 'DRIFT' WHEN 'click' THEN 'POSTPROD_DEGRADATION' ELSE 'MANUAL' END AS trigger_type, CASE WHEN value > 20 THEN 'CRITICAL' ELSE 'WARNING' END AS trigger_severity,
  CASE event_id % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'APPROVED' WHEN 2 THEN 'REJECTED' ELSE 'EXECUTED' END AS request_status, ts AS event_timestamp, event_id FROM events)"""
LATEST_SQL = "latest AS (SELECT * FROM requests QUALIFY row_number() OVER (PARTITION BY model_name, model_version, run_id ORDER BY event_timestamp DESC, event_id DESC) = 1)"


def requests(t: Tables) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    statuses = F.array(*[F.lit(s) for s in pl.REQUEST_STATUSES])
    return t.events.select(
        F.concat(F.lit("m"), user).alias("model_name"),
        F.when(user % 4 > 0, F.concat(F.lit("v"), user % 4)).alias("model_version"),
        F.concat(F.lit("r"), F.col("event_id") % 3).alias("run_id"),
        F.when(kind == "view", "DRIFT").when(kind == "click", "POSTPROD_DEGRADATION").otherwise("MANUAL").alias("trigger_type"),
        F.when(F.col("value") > 20, "CRITICAL").otherwise("WARNING").alias("trigger_severity"),
        F.get(statuses, (F.col("event_id") % 4).cast("int")).alias("request_status"),
        F.col("ts").alias("event_timestamp"),
        "event_id",
    )


@query("t4_auto_approval", f"WITH {REQUESTS_SQL} SELECT model_name, event_id, 'APPROVED' AS request_status FROM requests WHERE trigger_type = 'DRIFT' AND trigger_severity = 'CRITICAL'")
def t4(t: Tables) -> DataFrame:
    return pl.auto_approvals(requests(t), POLICY).select("model_name", "event_id", "request_status")


CHANGES_SQL = """changes AS (SELECT DISTINCT 'm' || user_id AS model_name, CASE WHEN user_id % 4 > 0 THEN 'v' || (user_id % 4) END AS model_version, r AS run_id,
  CASE user_id % 5 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'EXECUTED' WHEN 2 THEN 'REJECTED' WHEN 3 THEN 'OPEN' END AS new_status FROM events, (VALUES ('r0'), ('r1'), ('r9')) v(r))"""


@query("t5_transitions", f"""WITH {REQUESTS_SQL}, {LATEST_SQL}, {CHANGES_SQL} SELECT c.model_name, c.model_version, c.run_id, c.new_status, l.request_status AS previous_status,
  coalesce((l.request_status = 'OPEN' AND new_status IN ('APPROVED', 'REJECTED')) OR (l.request_status = 'APPROVED' AND new_status = 'EXECUTED'), false) AS is_allowed
  FROM changes c LEFT JOIN latest l ON c.model_name = l.model_name AND c.model_version IS NOT DISTINCT FROM l.model_version AND c.run_id = l.run_id""")  # fmt: skip
def t5(t: Tables) -> DataFrame:
    user = F.col("user_id")
    new = F.array(*[F.lit(s) for s in ("APPROVED", "EXECUTED", "REJECTED", "OPEN")])
    changes = t.events.select(
        F.concat(F.lit("m"), user).alias("model_name"),
        F.when(user % 4 > 0, F.concat(F.lit("v"), user % 4)).alias("model_version"),
        F.explode(F.array(F.lit("r0"), F.lit("r1"), F.lit("r9"))).alias("run_id"),
        F.get(new, (user % 5).cast("int")).alias("new_status"),
    ).distinct()
    return pl.judge_transitions(changes, requests(t))


@query("t5_executed_requests", f"""WITH {REQUESTS_SQL}, {LATEST_SQL}, trained AS (SELECT DISTINCT model_name, model_version, run_id, 'n' || model_name AS new_model_version FROM requests WHERE event_id % 10 > 2)
  SELECT l.model_name, l.model_version, l.run_id, 'EXECUTED' AS request_status, t.new_model_version FROM latest l JOIN trained t ON l.model_name = t.model_name
  AND l.model_version IS NOT DISTINCT FROM t.model_version AND l.run_id = t.run_id WHERE l.request_status = 'APPROVED'""")  # fmt: skip
def t5_executed(t: Tables) -> DataFrame:
    rows = requests(t)
    keys = ["model_name", "model_version", "run_id"]
    trained = rows.filter(F.col("event_id") % 10 > 2).select(*keys).distinct()
    trained = trained.withColumn("new_model_version", F.concat(F.lit("n"), "model_name"))
    return pl.executed_requests(rows, trained).select(*keys, "request_status", "new_model_version")


@query("t6_open_requests", "SELECT 'm' || user_id AS model_name, 'MANUAL' AS trigger_type, 'console' AS trigger_source, 'OPEN' AS request_status, 'e' || event_id AS run_id, event_type AS reason FROM events")
def t6(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.concat(F.lit("m"), "user_id").alias("model_name"), F.concat(F.lit("e"), "event_id").alias("run_id"), F.col("event_type").alias("reason")
    )
    opened = pl.open_requests(rows, trigger_type="MANUAL", trigger_source="console")
    stored = conform_events(event_rows(opened, ts("2024-02-01"), "dev", "demo"), "tb_model_retraining_requests")
    return stored.select("model_name", "trigger_type", "trigger_source", "request_status", "run_id", "reason")


@query("t7_retraining_gate", "WITH m AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN event_id % 100 / 100 END AS f1 FROM events) "
       "SELECT event_id, 'post_retraining' AS gate_name, coalesce(f1 >= 0.7, false) AS approved, 'f1=' || coalesce(CAST(f1 AS VARCHAR), 'None') || "
       "CASE WHEN f1 >= 0.7 THEN ' atende threshold=0.7' ELSE ' abaixo do threshold=0.7' END AS reason FROM m")  # fmt: skip
def t7(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when(F.col("event_type") != "view", F.col("event_id") % 100 / 100).alias("f1"))
    return pl.retraining_gate(rows, pl.DEFAULT_MINIMA).drop("f1")


@query("t8_rollback_gate", f"""WITH {REQUESTS_SQL}, smoke AS (SELECT DISTINCT model_name, model_version FROM requests WHERE request_status = 'EXECUTED'),
  rollbacks AS (SELECT DISTINCT model_name, model_version FROM requests)
  SELECT r.*, 'post_rollback' AS gate_name, s.model_name IS NOT NULL AS approved, CASE WHEN s.model_name IS NOT NULL THEN 'Smoke validado apos rollback' ELSE 'Smoke obrigatorio apos rollback ainda nao validado' END AS reason
  FROM rollbacks r LEFT JOIN smoke s ON r.model_name = s.model_name AND r.model_version IS NOT DISTINCT FROM s.model_version""")  # fmt: skip
def t8(t: Tables) -> DataFrame:
    rows = requests(t)
    smoke = rows.withColumn("status", F.when(F.col("request_status") == "EXECUTED", "SUCCESS").otherwise("STARTED"))
    return pl.rollback_gate(rows.select("model_name", "model_version").distinct(), smoke.select("model_name", "model_version", "status"))


@query("t9_cycle_key", "SELECT event_id, 'drift_cycle|m' || user_id || '|' || CASE WHEN user_id % 2 = 0 THEN 'v1' ELSE '' END || '|2024-01-01|' || '|' || CASE WHEN value > 50 THEN 'CRITICAL' ELSE '' END AS execution_key FROM events")
def t9(t: Tables) -> DataFrame:
    key = cycle_key(
        F.lit("drift_cycle"),
        F.concat(F.lit("m"), "user_id"),
        F.when(F.col("user_id") % 2 == 0, "v1"),
        F.lit("2024-01-01"),
        F.lit(None).cast("string"),
        F.when(F.col("value") > 50, "CRITICAL"),
    )
    return t.events.select("event_id", key.alias("execution_key"))


@query("t10_cycle_order", """WITH runs AS (SELECT user_id, ts, CASE event_type WHEN 'view' THEN 'drift_cycle' WHEN 'click' THEN 'postprod_cycle' WHEN 'error' THEN 'retraining_cycle' WHEN 'signup' THEN 'operational_cycle'
    ELSE CASE WHEN user_id % 7 = 0 THEN 'other_cycle' ELSE 'drift_cycle' END END AS cycle FROM events),
  firsts AS (SELECT user_id, cycle, min(ts) AS first_at FROM runs GROUP BY 1, 2)
  SELECT user_id, coalesce(string_agg(cycle, ',' ORDER BY first_at) = 'drift_cycle,postprod_cycle,retraining_cycle,operational_cycle', false) AS is_valid FROM firsts GROUP BY 1""")  # fmt: skip
def t10(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    cycle = (
        F.when(kind == "view", "drift_cycle").when(kind == "click", "postprod_cycle").when(kind == "error", "retraining_cycle")
        .when(kind == "signup", "operational_cycle").when(F.col("user_id") % 7 == 0, "other_cycle").otherwise("drift_cycle")
    )
    return pl.cycle_order_check(t.events.select("user_id", "ts", cycle.alias("cycle")), "user_id", "cycle", "ts")


RETAINED_SQL = """rows AS (SELECT CASE l_linenumber % 7 WHEN 0 THEN 'tb_model_predictions' WHEN 1 THEN 'tb_ml_alert_events' WHEN 2 THEN 'tb_model_postprod_metrics' WHEN 3 THEN 'tb_model_retraining_requests'
  WHEN 4 THEN 'tb_ml_governance_runs' WHEN 5 THEN 'tb_ml_smoke_runs' ELSE 'tb_other' END AS table_name, l_shipdate AS event_timestamp, l_orderkey FROM lineitem),
  days AS (SELECT * FROM (VALUES ('tb_model_predictions', 90), ('tb_ml_alert_events', 180), ('tb_model_postprod_metrics', 365), ('tb_model_retraining_requests', 365), ('tb_ml_governance_runs', 365), ('tb_ml_smoke_runs', 180)) v(table_name, retention_days)),
  dated AS (SELECT r.*, retention_days, coalesce(event_timestamp < TIMESTAMP '2000-07-01' - to_days(CAST(retention_days AS INTEGER)), false) AS expired FROM rows r LEFT JOIN days USING (table_name))"""


def retained_rows(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(n) for n in (*pl.DEFAULT_RETENTION_DAYS, "tb_other")])
    return t.lineitem.select(
        F.get(names, F.col("l_linenumber") % 7).alias("table_name"), F.col("l_shipdate").alias("event_timestamp"), "l_orderkey"
    )


@query("t11_retention_counts", f"WITH {RETAINED_SQL} SELECT table_name, retention_days, count(*) FILTER (NOT expired) AS kept_rows, count(*) FILTER (expired) AS expired_rows FROM dated GROUP BY 1, 2")
def t11(t: Tables) -> DataFrame:
    return pl.retention_counts(retained_rows(t), ts("2000-07-01"))


@query("t11_retention_kept", "SELECT l_orderkey, l_shipdate AS event_timestamp FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-07-01' - INTERVAL 180 DAY")
def t11_kept(t: Tables) -> DataFrame:
    kept, _ = pl.retention_split(t.lineitem.select("l_orderkey", F.col("l_shipdate").alias("event_timestamp")), 180, ts("2000-07-01"))
    return kept


@query("t11_apply", """WITH kept AS (SELECT 'lineitem' AS table_name, l_shipdate AS moment FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-07-01 06:00:00' - INTERVAL 900 DAY
  UNION ALL SELECT 'orders', o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2000-07-01 06:00:00' - INTERVAL 1500 DAY UNION ALL SELECT 'events', ts FROM events)
  SELECT table_name, count(*) AS kept_rows, min(moment) AS oldest FROM kept GROUP BY 1""")  # fmt: skip
def t11_apply(t: Tables) -> DataFrame:
    """Three stored tables in monthly partitions, each with its own number of days; the second call changes nothing."""
    schema = scratch_schema(t.spark)
    days = {}
    for name, rows, kept in (("lineitem", t.lineitem.select(F.col("l_shipdate").alias("at")), 900), ("orders", t.orders.select(F.col("o_orderdate").alias("at")), 1500),
                             ("events", t.events.select(F.col("ts").alias("at")), 180)):
        table = f"{schema}.{name}_{uuid.uuid4().hex[:12]}"
        append_periods(rows, table, "at", "month")
        days[table] = kept
    for _ in range(2):
        apply_retention(t.spark, days, datetime(2000, 7, 1, 6), "at", "month")
    parts = [t.spark.table(table).select(F.lit(table.split(".")[1].split("_")[0]).alias("table_name"), "at") for table in days]
    return reduce(DataFrame.unionByName, parts).groupBy("table_name").agg(F.count(F.lit(1)).alias("kept_rows"), F.min("at").alias("oldest"))
