"""Registry, deployments, promotion and rollback."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.checks.base import Tables, query, scratch_folder, scratch_schema, ts
from lakeops.operators import lifecycle as lc
from lakeops.operators import reconcile
from lakeops.operators.events import event_rows, newest
from lakeops.plans.lifecycle import run_promotions, run_rollbacks
from lakeops.plans.snapshots import current_state, store_snapshot
from lakeops.sources.tables import append_events, conform_events

# ---- stand-ins from orders: one model per customer, one version per order priority ---------------

REGISTRY_SQL = """registry AS (SELECT 'm' || o_custkey AS model_name, o_orderpriority AS model_version, 'logistic_regression' AS algorithm,
  'r' || o_orderkey AS run_id, o_orderdate AS event_timestamp, o_orderkey AS event_id,
  CASE WHEN o_orderkey % 11 = 0 THEN 'UNKNOWN' WHEN o_orderstatus = 'F' THEN 'DEPLOYED_PRD' WHEN o_orderstatus = 'O' THEN 'TRAINED' ELSE 'ROLLED_BACK' END AS status,
  CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN '' ELSE 'base/' || o_orderkey END AS artifact_path FROM orders)"""
DEPLOYMENTS_SQL = """deployments AS (SELECT 'm' || o_custkey AS model_name, o_orderpriority AS model_version, 'base/' || o_orderkey AS artifact_path,
  CASE WHEN o_orderkey % 2 = 0 THEN 'dev' END AS source_env, CASE o_orderkey % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'hml' ELSE 'prd' END AS target_env,
  CASE WHEN o_orderstatus = 'O' THEN 'DEPLOYED' WHEN o_orderstatus = 'F' THEN 'INACTIVE' ELSE 'FAILED' END AS deployment_status,
  o_orderstatus = 'O' AS is_active, 'r' || o_orderkey AS run_id, o_orderdate AS event_timestamp, o_orderkey AS event_id FROM orders)"""
LATEST_REGISTRY_SQL = """latest AS (SELECT * FROM registry QUALIFY row_number() OVER (PARTITION BY model_name, model_version ORDER BY event_timestamp DESC, event_id DESC) = 1)"""
STATES_SQL = ", ".join(f"'{s}'" for s in lc.MODEL_STATES)
VALID_SQL = f"""valid AS (SELECT * FROM registry WHERE status IN ({STATES_SQL}) AND trim(artifact_path) <> ''
  QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY event_timestamp DESC, event_id DESC) = 1)"""
ACTIVE_SQL = """active AS (SELECT * FROM deployments WHERE is_active QUALIFY row_number() OVER (PARTITION BY model_name, target_env ORDER BY event_timestamp DESC, event_id DESC) = 1)"""
LOOKUP_SQL = """wanted AS (SELECT 'm' || c_custkey AS model_name, CASE WHEN c_nationkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS model_version FROM customer)"""


def registry(t: Tables) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return t.orders.select(
        F.concat(F.lit("m"), "o_custkey").alias("model_name"),
        F.col("o_orderpriority").alias("model_version"),
        F.lit("logistic_regression").alias("algorithm"),
        F.concat(F.lit("r"), key).alias("run_id"),
        F.col("o_orderdate").alias("event_timestamp"),
        key.alias("event_id"),
        F.when(key % 11 == 0, "UNKNOWN").when(status == "F", "DEPLOYED_PRD").when(status == "O", "TRAINED").otherwise("ROLLED_BACK").alias("status"),
        F.when(key % 7 == 1, "  ").when(key % 7 == 2, "").when(key % 7 > 2, F.concat(F.lit("base/"), key)).alias("artifact_path"),
    )


def deployments(t: Tables) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return t.orders.select(
        F.concat(F.lit("m"), "o_custkey").alias("model_name"),
        F.col("o_orderpriority").alias("model_version"),
        F.concat(F.lit("base/"), key).alias("artifact_path"),
        F.when(key % 2 == 0, "dev").alias("source_env"),
        F.when(key % 3 == 0, "dev").when(key % 3 == 1, "hml").otherwise("prd").alias("target_env"),
        F.when(status == "O", "DEPLOYED").when(status == "F", "INACTIVE").otherwise("FAILED").alias("deployment_status"),
        (status == "O").alias("is_active"),
        F.concat(F.lit("r"), key).alias("run_id"),
        F.col("o_orderdate").alias("event_timestamp"),
        key.alias("event_id"),
    )


def wanted(t: Tables) -> DataFrame:
    return t.customer.select(
        F.concat(F.lit("m"), "c_custkey").alias("model_name"),
        F.when(F.col("c_nationkey") % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("model_version"),
    )


@query("r1_latest_registry", f"WITH {REGISTRY_SQL}, {LATEST_REGISTRY_SQL} SELECT model_name, model_version, status, run_id FROM latest")
def r1(t: Tables) -> DataFrame:
    return lc.latest_registry(registry(t)).select("model_name", "model_version", "status", "run_id")


@query("r2_latest_valid_model", f"WITH {REGISTRY_SQL}, {VALID_SQL} SELECT model_name, model_version, status, artifact_path FROM valid")
def r2(t: Tables) -> DataFrame:
    return lc.latest_valid_models(registry(t)).select("model_name", "model_version", "status", "artifact_path")


@query("r3_artifact_lookup", f"""WITH {REGISTRY_SQL}, {LATEST_REGISTRY_SQL}, {LOOKUP_SQL}, j AS (SELECT w.*, l.status, l.artifact_path,
  CASE WHEN l.status IS NULL THEN 'NOT_FOUND' WHEN coalesce(l.artifact_path, '') = '' THEN 'MISSING_PATH' WHEN l.status NOT IN ({STATES_SQL}) THEN 'BAD_STATUS' END AS reason
  FROM wanted w LEFT JOIN latest l USING (model_name, model_version))
  SELECT model_name, model_version, reason, CASE WHEN reason IS NULL THEN artifact_path END AS artifact_path,
  'root/' || model_name || '/' || model_version AS built_path FROM j""")  # fmt: skip
def r3(t: Tables) -> DataFrame:
    rows = lc.artifact_lookup(wanted(t), registry(t))
    return rows.select("model_name", "model_version", "reason", "artifact_path", lc.artifact_path("root").alias("built_path"))


@query("r4_status_events", f"""WITH {REGISTRY_SQL}, {LATEST_REGISTRY_SQL}, {LOOKUP_SQL}, changes AS (SELECT *, CASE WHEN model_version = '5-LOW' THEN 'ARCHIVED' ELSE 'EVALUATED' END AS status FROM wanted)
  SELECT c.model_name, c.model_version, c.status, l.algorithm, l.run_id, l.artifact_path FROM changes c JOIN latest l USING (model_name, model_version) WHERE c.status IN ({STATES_SQL})""")  # fmt: skip
def r4(t: Tables) -> DataFrame:
    changes = wanted(t).withColumn("status", F.when(F.col("model_version") == "5-LOW", "ARCHIVED").otherwise("EVALUATED"))
    rows = event_rows(lc.status_events(changes, registry(t)), ts("2024-02-01"), "dev", "demo")
    stored = conform_events(rows, "tb_model_registry")
    return stored.select("model_name", "model_version", "status", "algorithm", "run_id", "artifact_path")


@query("r4_invalid_states", f"WITH {REGISTRY_SQL} SELECT model_name, event_id, status FROM registry WHERE status NOT IN ({STATES_SQL})")
def r4_invalid(t: Tables) -> DataFrame:
    return lc.invalid_states(registry(t)).select("model_name", "event_id", "status")


@query("r5_active_deployment", f"WITH {DEPLOYMENTS_SQL}, {ACTIVE_SQL} SELECT model_name, target_env, model_version, run_id FROM active")
def r5(t: Tables) -> DataFrame:
    return lc.active_deployments(deployments(t)).select("model_name", "target_env", "model_version", "run_id")


@query("r5_active_deployment_strict", f"WITH {DEPLOYMENTS_SQL}, latest AS (SELECT * FROM deployments QUALIFY row_number() OVER "
       "(PARTITION BY model_name, target_env ORDER BY event_timestamp DESC, event_id DESC) = 1) "
       "SELECT model_name, target_env, model_version, run_id FROM latest WHERE is_active")  # fmt: skip
def r5_strict(t: Tables) -> DataFrame:
    return lc.active_deployments(deployments(t), strict=True).select("model_name", "target_env", "model_version", "run_id")


def _activation_sql(requests: str) -> str:
    return f"""SELECT r.model_name, a.model_version, a.artifact_path, a.source_env, r.target_env, 'INACTIVE' AS deployment_status, false AS is_active, a.run_id,
      'Desativado por nova ativacao da versao ' || r.model_version AS notes, 1 AS step FROM {requests} r JOIN active a USING (model_name, target_env)
      UNION ALL SELECT model_name, model_version, artifact_path, source_env, target_env, deployment_status, true, run_id, notes, 2 FROM {requests}"""


@query("r6_activation", f"""WITH {DEPLOYMENTS_SQL}, {ACTIVE_SQL}, requests AS (SELECT 'm' || c_custkey AS model_name, 'v9' AS model_version, 'new/' || c_custkey AS artifact_path,
  'dev' AS source_env, 'hml' AS target_env, 'DEPLOYED_HML' AS deployment_status, 'q' || c_custkey AS run_id, 'go' AS notes FROM customer) {_activation_sql('requests')}""")  # fmt: skip
def r6_activation(t: Tables) -> DataFrame:
    requests = t.customer.select(
        F.concat(F.lit("m"), "c_custkey").alias("model_name"),
        F.lit("v9").alias("model_version"),
        F.concat(F.lit("new/"), "c_custkey").alias("artifact_path"),
        F.lit("dev").alias("source_env"),
        F.lit("hml").alias("target_env"),
        F.lit("DEPLOYED_HML").alias("deployment_status"),
        F.concat(F.lit("q"), "c_custkey").alias("run_id"),
        F.lit("go").alias("notes"),
    )
    return lc.activation_events(requests, deployments(t))


@query("r6_activation_sequence", f"""WITH {DEPLOYMENTS_SQL}, {ACTIVE_SQL}, requests AS (SELECT 'm' || o_custkey AS model_name, 'n' || o_orderkey AS model_version,
  'new/' || o_orderkey AS artifact_path, 'dev' AS source_env, 'hml' AS target_env, 'DEPLOYED_HML' AS deployment_status, 'q' || lpad(o_orderkey::VARCHAR, 12, '0') AS run_id,
  'go' AS notes, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS turn FROM orders),
  retired AS (SELECT n.model_name, n.target_env, n.model_version AS next_version, n.turn, o.model_version, o.artifact_path, o.source_env, o.run_id
    FROM requests n JOIN requests o ON n.model_name = o.model_name AND n.turn = o.turn + 1
    UNION ALL SELECT n.model_name, n.target_env, n.model_version, n.turn, a.model_version, a.artifact_path, a.source_env, a.run_id
    FROM requests n JOIN active a USING (model_name, target_env) WHERE n.turn = 1)
  SELECT model_name, model_version, artifact_path, source_env, target_env, 'INACTIVE' AS deployment_status, false AS is_active, run_id,
    'Desativado por nova ativacao da versao ' || next_version AS notes, (2 * turn - 1)::INTEGER AS step FROM retired
  UNION ALL SELECT model_name, model_version, artifact_path, source_env, target_env, deployment_status, true, run_id, notes, (2 * turn)::INTEGER FROM requests""")  # fmt: skip
def r6_activation_sequence(t: Tables) -> DataFrame:
    """One request per order: the requests of one customer's model follow each other."""
    requests = t.orders.select(
        F.concat(F.lit("m"), "o_custkey").alias("model_name"),
        F.concat(F.lit("n"), "o_orderkey").alias("model_version"),
        F.concat(F.lit("new/"), "o_orderkey").alias("artifact_path"),
        F.lit("dev").alias("source_env"),
        F.lit("hml").alias("target_env"),
        F.lit("DEPLOYED_HML").alias("deployment_status"),
        F.concat(F.lit("q"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("run_id"),
        F.lit("go").alias("notes"),
    )
    return lc.activation_events(requests, deployments(t))


CANDIDATES_SQL = """per_version AS (SELECT d.*, a.model_version AS current_version FROM deployments d JOIN active a USING (model_name, target_env)
    WHERE d.model_version <> a.model_version QUALIFY row_number() OVER (PARTITION BY d.model_name, d.target_env, d.model_version ORDER BY d.event_timestamp DESC, d.event_id DESC) = 1),
  candidates AS (SELECT * FROM per_version WHERE deployment_status = 'INACTIVE'
    QUALIFY row_number() OVER (PARTITION BY model_name, target_env ORDER BY event_timestamp DESC, event_id DESC) = 1)"""


@query("r7_rollback_candidate", f"WITH {DEPLOYMENTS_SQL}, {ACTIVE_SQL}, {CANDIDATES_SQL} SELECT model_name, target_env, current_version AS current_model_version, model_version, run_id FROM candidates")
def r7(t: Tables) -> DataFrame:
    events = deployments(t)
    requests = lc.active_deployments(events).select("model_name", "target_env", F.col("model_version").alias("current_model_version"))
    rows = lc.rollback_candidates(requests, events)
    return rows.select("model_name", "target_env", "current_model_version", "model_version", "run_id")


ROLLBACK_SQL = f"""{DEPLOYMENTS_SQL}, {REGISTRY_SQL}, {LATEST_REGISTRY_SQL}, {ACTIVE_SQL}, {CANDIDATES_SQL},
  requests AS (SELECT 'm' || c_custkey AS model_name, e AS target_env, 'g' || c_custkey AS run_id FROM customer, (VALUES ('dev'), ('hml'), ('prd')) v(e)),
  plan AS (SELECT r.*, a.model_version AS from_version, c.model_version AS to_version, c.artifact_path AS to_artifact_path, c.source_env AS to_source_env, c.run_id AS to_run_id,
    CASE WHEN r.target_env NOT IN ('hml', 'prd') THEN 'INVALID_TARGET' WHEN a.model_version IS NULL THEN 'NO_ACTIVE_DEPLOYMENT'
      WHEN c.model_version IS NULL THEN 'NO_CANDIDATE' WHEN l.model_version IS NULL THEN 'NOT_IN_REGISTRY' END AS reason
    FROM requests r LEFT JOIN active a USING (model_name, target_env) LEFT JOIN candidates c USING (model_name, target_env)
    LEFT JOIN latest l ON l.model_name = r.model_name AND l.model_version = a.model_version)"""


def rollback_requests(t: Tables) -> DataFrame:
    return t.customer.select(
        F.concat(F.lit("m"), "c_custkey").alias("model_name"),
        F.explode(F.array(F.lit("dev"), F.lit("hml"), F.lit("prd"))).alias("target_env"),
        F.concat(F.lit("g"), "c_custkey").alias("run_id"),
    )


def rollback_plan(t: Tables) -> DataFrame:
    return lc.rollback_plan(rollback_requests(t), deployments(t), registry(t))


@query("r8_rollback_plan", f"WITH {ROLLBACK_SQL} SELECT model_name, target_env, run_id, from_version, to_version, to_artifact_path, reason FROM plan")
def r8(t: Tables) -> DataFrame:
    return rollback_plan(t).select("model_name", "target_env", "run_id", "from_version", "to_version", "to_artifact_path", "reason")


@query("r8_rollback_deployments", f"""WITH {ROLLBACK_SQL}, accepted AS (SELECT model_name, to_version AS model_version, to_artifact_path AS artifact_path, to_source_env AS source_env, target_env,
  'ROLLED_BACK_ACTIVE' AS deployment_status, to_run_id AS run_id, 'Rollback ativou versao ' || to_version AS notes FROM plan WHERE reason IS NULL) {_activation_sql('accepted')}""")  # fmt: skip
def r8_deployments(t: Tables) -> DataFrame:
    return lc.rollback_deployment_events(rollback_plan(t), deployments(t))


@query("r8_rollback_statuses", f"WITH {ROLLBACK_SQL} SELECT p.model_name, p.from_version AS model_version, 'ROLLED_BACK' AS status, l.run_id "
       "FROM plan p JOIN latest l ON l.model_name = p.model_name AND l.model_version = p.from_version WHERE p.reason IS NULL")  # fmt: skip
def r8_statuses(t: Tables) -> DataFrame:
    rows = lc.rollback_status_events(rollback_plan(t), registry(t))
    return rows.select("model_name", "model_version", "status", "run_id")


@query("r8_rollback_governance", f"""WITH {ROLLBACK_SQL} SELECT model_name, target_env, run_id, 1 AS step, 'STARTED' AS status, NULL::VARCHAR AS model_version, 'Rollback iniciado' AS message FROM plan WHERE target_env <> 'dev'
  UNION ALL SELECT model_name, target_env, run_id, 2, CASE WHEN reason IS NULL THEN 'SUCCESS' ELSE 'ERROR' END, CASE WHEN reason IS NULL THEN to_version END,
  CASE WHEN reason IS NULL THEN 'Rollback executado de ' || from_version || ' para ' || to_version ELSE 'ValueError: ' || reason END FROM plan WHERE target_env <> 'dev'""")  # fmt: skip
def r8_governance(t: Tables) -> DataFrame:
    rows = lc.rollback_governance_events(rollback_plan(t))
    return rows.select("model_name", "target_env", "run_id", "step", "status", "model_version", "message")


# ---- promotion ----------------------------------------------------------------------------------

CANDIDATE_SQL = """candidates AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'dev' ELSE 'hml' END AS source_env,
  CASE o_orderkey % 4 WHEN 0 THEN 'hml' ELSE 'prd' END AS target_env, CASE WHEN o_orderkey % 13 > 0 THEN o_custkey % 100 / 100 END AS accuracy,
  CASE WHEN o_orderkey % 17 > 0 THEN (o_custkey + 31) % 100 / 100 END AS f1, (o_custkey + 57) % 100 / 100 AS auc,
  o_orderstatus <> 'P' AS tests_passed, o_orderpriority < '4' AS manual_approval FROM orders)"""


def candidates(t: Tables) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        key.alias("id"),
        F.when(key % 3 == 0, "dev").otherwise("hml").alias("source_env"),
        F.when(key % 4 == 0, "hml").otherwise("prd").alias("target_env"),
        F.when(key % 13 > 0, cust % 100 / 100).alias("accuracy"),
        F.when(key % 17 > 0, (cust + 31) % 100 / 100).alias("f1"),
        ((cust + 57) % 100 / 100).alias("auc"),
        (F.col("o_orderstatus") != "P").alias("tests_passed"),
        (F.col("o_orderpriority") < "4").alias("manual_approval"),
    )


# Rule rows of one environment: source, target, position, approval, tests, gates, minima.
PROMOTION_RULES = [
    ("dev", "hml", 0, False, True, False, 0.65, 0.55, 0.65),
    ("hml", "prd", 1, True, True, True, 0.65, 0.55, 0.65),
    ("hml", "prd", 2, False, False, False, 0.0, 0.0, 0.0),
]
RULE_COLUMNS = (
    "source_env STRING, target_env STRING, position INT, requires_approval BOOLEAN, require_tests_passed BOOLEAN, "
    "require_quality_gates BOOLEAN, minimum_accuracy DOUBLE, minimum_f1 DOUBLE, minimum_auc DOUBLE"
)


def promotion_rules(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(PROMOTION_RULES, RULE_COLUMNS)


# Numbers are compared as numbers, so the SQL keeps them out of the reason text.
STRIP = r"(accuracy|f1|auc) \S+ below minimum \S+"


@query("r9_promotion_decision", f"""WITH {CANDIDATE_SQL}, d AS (SELECT *, CASE
    WHEN NOT ((source_env = 'dev' AND target_env = 'hml') OR (source_env = 'hml' AND target_env = 'prd')) THEN 'Promotion blocked: no promotion rule configured for ' || source_env || ' -> ' || target_env || '.'
    WHEN NOT tests_passed THEN 'Promotion blocked: automated tests did not pass.'
    WHEN source_env = 'hml' AND NOT manual_approval THEN 'Promotion blocked: manual approval is required.'
    WHEN source_env = 'hml' AND (accuracy IS NULL OR accuracy < 0.65) THEN 'Promotion blocked: accuracy below.'
    WHEN source_env = 'hml' AND (f1 IS NULL OR f1 < 0.55) THEN 'Promotion blocked: f1 below.'
    WHEN source_env = 'hml' AND auc < 0.65 THEN 'Promotion blocked: auc below.' ELSE 'Promotion approved.' END AS reason FROM candidates)
  SELECT id, reason, reason = 'Promotion approved.' AS approved FROM d""")  # fmt: skip
def r9(t: Tables) -> DataFrame:
    rows = lc.promotion_decisions(candidates(t), promotion_rules(t))
    return rows.select("id", F.regexp_replace("reason", STRIP, "$1 below.").alias("reason"), "approved")


@query("j4_rule_lookup", f"WITH {CANDIDATE_SQL} SELECT id, CASE WHEN source_env = 'dev' AND target_env = 'hml' THEN 0 WHEN source_env = 'hml' AND target_env = 'prd' THEN 1 END AS position FROM candidates")
def j4(t: Tables) -> DataFrame:
    rows = reconcile.with_rule(candidates(t), promotion_rules(t), ["source_env", "target_env"], [F.col("position").asc()])
    return rows.select("id", "position")


REQUESTS_SQL = """requests AS (SELECT 'm' || c_custkey AS model_name, CASE c_nationkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' END AS model_version,
  CASE c_nationkey % 4 WHEN 0 THEN 'dev' ELSE 'hml' END AS source_env, CASE c_nationkey % 8 WHEN 0 THEN 'hml' ELSE 'prd' END AS target_env, 'g' || c_custkey AS run_id FROM customer)"""
PROMOTION_SQL = f"""{REGISTRY_SQL}, {LATEST_REGISTRY_SQL}, {VALID_SQL}, {DEPLOYMENTS_SQL}, {ACTIVE_SQL}, {REQUESTS_SQL},
  resolved AS (SELECT r.*, coalesce(l.model_version, v.model_version) AS resolved_version,
      CASE WHEN r.model_version IS NOT NULL THEN l.artifact_path ELSE v.artifact_path END AS artifact_path,
      CASE WHEN r.model_version IS NOT NULL THEN l.run_id ELSE v.run_id END AS deployment_run_id,
      CASE WHEN r.model_version IS NOT NULL THEN l.status ELSE v.status END AS registry_status
    FROM requests r LEFT JOIN latest l ON r.model_name = l.model_name AND r.model_version = l.model_version
    LEFT JOIN valid v ON r.model_name = v.model_name AND r.model_version IS NULL),
  judged AS (SELECT r.*, a.model_version AS active_version, a.deployment_status AS active_status, CASE
      WHEN NOT ((source_env = 'dev' AND r.target_env = 'hml') OR (r.source_env = 'hml' AND r.target_env = 'prd')) THEN 'INVALID_PATH'
      WHEN resolved_version IS NULL THEN 'MODEL_NOT_FOUND' WHEN coalesce(r.artifact_path, '') = '' THEN 'MISSING_ARTIFACT'
      WHEN registry_status NOT IN ({STATES_SQL}) THEN 'INVALID_STATUS' END AS reason
    FROM resolved r LEFT JOIN (SELECT model_name, target_env, model_version, deployment_status FROM active) a USING (model_name, target_env)),
  plan AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'REJECTED' WHEN active_version = resolved_version THEN 'ALREADY_ACTIVE' ELSE 'PROMOTE' END AS outcome FROM judged)""".replace(
    "WHEN NOT ((source_env", "WHEN NOT ((r.source_env"
)


def promotion_requests(t: Tables) -> DataFrame:
    nation = F.col("c_nationkey")
    return t.customer.select(
        F.concat(F.lit("m"), "c_custkey").alias("model_name"),
        F.when(nation % 3 == 0, "1-URGENT").when(nation % 3 == 1, "5-LOW").alias("model_version"),
        F.when(nation % 4 == 0, "dev").otherwise("hml").alias("source_env"),
        F.when(nation % 8 == 0, "hml").otherwise("prd").alias("target_env"),
        F.concat(F.lit("g"), "c_custkey").alias("run_id"),
    )


def promotion_plan(t: Tables) -> DataFrame:
    return lc.promotion_plan(promotion_requests(t), registry(t), deployments(t))


@query("r10_promotion_plan", f"""WITH {PROMOTION_SQL} SELECT model_name, source_env, target_env, resolved_version, reason, outcome,
  CASE outcome WHEN 'PROMOTE' THEN 'DEPLOYED_' || upper(target_env) WHEN 'ALREADY_ACTIVE' THEN active_status END AS final_status FROM plan""")  # fmt: skip
def r10(t: Tables) -> DataFrame:
    return promotion_plan(t).select("model_name", "source_env", "target_env", "resolved_version", "reason", "outcome", "final_status")


@query("r10_promotion_statuses", f"""WITH {PROMOTION_SQL}, steps AS (SELECT *, unnest([1, 2, 3]) AS step FROM plan WHERE outcome = 'PROMOTE')
  SELECT s.model_name, s.resolved_version AS model_version, s.step, CASE step WHEN 1 THEN 'PROMOTION_APPROVED' WHEN 2 THEN 'PROMOTED_' || upper(target_env) ELSE 'DEPLOYED_' || upper(target_env) END AS status,
  l.run_id FROM steps s JOIN latest l ON s.model_name = l.model_name AND s.resolved_version = l.model_version""")  # fmt: skip
def r10_statuses(t: Tables) -> DataFrame:
    rows = lc.promotion_status_events(promotion_plan(t), registry(t))
    return rows.select("model_name", "model_version", "step", "status", "run_id")


@query("r10_promotion_deployments", f"""WITH {PROMOTION_SQL}, accepted AS (SELECT model_name, resolved_version AS model_version, artifact_path, source_env, target_env,
  'DEPLOYED_' || upper(target_env) AS deployment_status, deployment_run_id AS run_id, 'Promocao ' || source_env || '->' || target_env AS notes FROM plan WHERE outcome = 'PROMOTE') {_activation_sql('accepted')}""")  # fmt: skip
def r10_deployments(t: Tables) -> DataFrame:
    return lc.promotion_deployment_events(promotion_plan(t), deployments(t))


@query("r10_promotion_log", f"WITH {PROMOTION_SQL} SELECT model_name, resolved_version AS model_version, artifact_path, source_env, target_env, "
       "'PROMOTION_APPROVED' AS status, 'Promotion request accepted' AS reason FROM plan WHERE outcome = 'PROMOTE'")  # fmt: skip
def r10_log(t: Tables) -> DataFrame:
    return lc.promotion_log_events(promotion_plan(t))


@query("r10_promotion_governance", f"""WITH {PROMOTION_SQL} SELECT model_name, run_id, 1 AS step, 'STARTED' AS status, model_version, 'Promotion iniciada' AS message FROM plan WHERE reason IS DISTINCT FROM 'INVALID_PATH'
  UNION ALL SELECT model_name, run_id, 2, CASE WHEN outcome = 'REJECTED' THEN 'ERROR' ELSE 'SUCCESS' END, CASE WHEN outcome = 'REJECTED' THEN model_version ELSE resolved_version END,
  CASE outcome WHEN 'PROMOTE' THEN 'Promotion concluida com status DEPLOYED_' || upper(target_env) WHEN 'ALREADY_ACTIVE' THEN 'Model already active in target environment' ELSE 'ValueError: ' || reason END
  FROM plan WHERE reason IS DISTINCT FROM 'INVALID_PATH'""")  # fmt: skip
def r10_governance(t: Tables) -> DataFrame:
    rows = lc.promotion_governance_events(promotion_plan(t))
    return rows.select("model_name", "run_id", "step", "status", "model_version", "message")


# ---- jobs over stored tables --------------------------------------------------------------------


def stored_history(t: Tables) -> str:
    """Schema with the stand-ins stored as event tables; the order of events at one time is kept in microseconds."""
    schema = f"{scratch_schema(t.spark)}_{uuid.uuid4().hex[:8]}"
    t.spark.sql(f"CREATE SCHEMA {schema} LOCATION '{scratch_folder(t.spark)}/{schema}'")
    for table, rows in (("tb_model_registry", registry(t)), ("tb_model_deployments", deployments(t))):
        at = F.col("event_timestamp").cast("timestamp") + F.make_interval(secs=F.col("event_id") / 1e6)
        append_events(event_rows(rows, at, "dev", "demo"), table, f"{schema}.{table}")
    return schema


@query("r8_rollback_job", f"""WITH {ROLLBACK_SQL} SELECT model_name, target_env, run_id, 'STARTED' AS status, NULL::VARCHAR AS model_version, 'Rollback iniciado' AS message FROM plan WHERE target_env <> 'dev'
  UNION ALL SELECT model_name, target_env, run_id, CASE WHEN reason IS NULL THEN 'SUCCESS' ELSE 'ERROR' END, CASE WHEN reason IS NULL THEN to_version END,
  CASE WHEN reason IS NULL THEN 'Rollback executado de ' || from_version || ' para ' || to_version ELSE 'ValueError: ' || reason END FROM plan WHERE target_env <> 'dev'""")  # fmt: skip
def r8_job(t: Tables) -> DataFrame:
    """The job in two halves, the second with all requests: those of the first half are not decided again."""
    schema, asked = stored_history(t), rollback_requests(t)
    for requests in (asked.filter("crc32(model_name) % 2 = 0"), asked):
        run_rollbacks(t.spark, schema, requests, ts("2030-01-01"), "dev", "demo", f"{schema}.plan", f"{scratch_folder(t.spark)}/{schema}-journal")
    return t.spark.table(f"{schema}.tb_ml_governance_runs").select("model_name", "target_env", "run_id", "status", "model_version", "message")


@query("r10_promotion_job", f"WITH {PROMOTION_SQL} SELECT model_name, resolved_version AS model_version, artifact_path, source_env, target_env, "
       "'PROMOTION_APPROVED' AS status, 'Promotion request accepted' AS reason FROM plan WHERE outcome = 'PROMOTE'")  # fmt: skip
def r10_job(t: Tables) -> DataFrame:
    """The job run twice with the same requests; the second run appends nothing."""
    schema, asked = stored_history(t), promotion_requests(t)
    for _ in range(2):
        run_promotions(t.spark, schema, asked, ts("2030-01-01"), "dev", "demo", f"{schema}.plan", f"{scratch_folder(t.spark)}/{schema}-journal")
    return t.spark.table(f"{schema}.tb_ml_model_promotions").select(
        "model_name", "model_version", "artifact_path", "source_env", "target_env", "status", "reason"
    )


@query("r1_snapshot_tail", f"WITH {REGISTRY_SQL}, {LATEST_REGISTRY_SQL} SELECT model_name, model_version, status, run_id FROM latest")
def r1_snapshot(t: Tables) -> DataFrame:
    """The same state from two stored snapshots, the second built on the first, and the events behind it."""
    path = f"{scratch_folder(t.spark)}/registry-{uuid.uuid4().hex}"
    events, order = registry(t), newest("event_timestamp", "event_id")
    for until in (datetime(1996, 1, 1), datetime(1998, 1, 1)):
        store_snapshot(events, path, lc.MODEL, order, until)
    return current_state(events, path, lc.MODEL, order).select("model_name", "model_version", "status", "run_id")
