"""Batch promotion and rollback jobs over stored event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators import lifecycle as lc
from lakeops.operators.events import event_rows
from lakeops.plans.journal import append_missing, decide_once
from lakeops.session import checkpoint_root
from lakeops.sources.tables import overwrite_table

REGISTRY, DEPLOYMENTS = "tb_model_registry", "tb_model_deployments"
GOVERNANCE, PROMOTIONS = "tb_ml_governance_runs", "tb_ml_model_promotions"


def _timed(df: DataFrame, as_of, env: str, project: str) -> DataFrame:
    """Event prefix; the step of a request is added as microseconds, so that the stored order of its
    events is the order in which they were decided."""
    start = as_of if not isinstance(as_of, str) else F.lit(as_of).cast("timestamp")
    rows = event_rows(df, start, env, project)
    if "step" in df.columns:
        micros = F.make_interval(secs=F.col("step") / 1e6)
        rows = rows.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp") + micros)
    return rows


def _journal(spark: SparkSession, schema: str, job: str, given: str | None) -> str:
    """Folder of a job's journal: the given one, else one per schema and job in the shared folder."""
    root = given or f"{checkpoint_root(spark, spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/journal/{schema}"
    return f"{root.rstrip('/')}/{job}"


def _carry_out(plan: DataFrame, events: dict[str, DataFrame], schema: str, plan_table: str) -> DataFrame:
    overwrite_table(plan, plan_table)
    for table, rows in events.items():
        append_missing(rows, table, f"{schema}.{table}")
    return plan.sparkSession.table(plan_table)


def run_rollbacks(
    spark: SparkSession, schema: str, requests: DataFrame, as_of, env: str, project: str, plan_table: str, journal: str | None = None
) -> DataFrame:
    """Decide the rollback requests that are not answered yet, append the deployment, registry and governance events of all
    given ones, and return their plan (also stored as ``plan_table``).

    A request is known by model, environment and run. Decisions and their events are journalled before anything is appended,
    and only missing event rows are appended: a job that is repeated, or stopped after any step and repeated, ends like one run.
    """
    registry, deployments = spark.table(f"{schema}.{REGISTRY}"), spark.table(f"{schema}.{DEPLOYMENTS}")

    def derive(plan: DataFrame) -> dict[str, DataFrame]:
        events = {
            DEPLOYMENTS: lc.rollback_deployment_events(plan, deployments),
            REGISTRY: lc.rollback_status_events(plan, registry),
            GOVERNANCE: lc.rollback_governance_events(plan),
        }
        return {table: _timed(rows, as_of, env, project) for table, rows in events.items()}

    folder = _journal(spark, schema, "rollback", journal)
    found = decide_once(requests, folder, [*lc.MODEL_ENV, "run_id"], lambda asked: lc.rollback_decisions(asked, deployments, registry), derive)
    return _carry_out(found[0].drop(*lc.ACTIVE_COLUMNS, *lc.REGISTRY_COLUMNS), found[1], schema, plan_table)


def run_promotions(
    spark: SparkSession, schema: str, requests: DataFrame, as_of, env: str, project: str, plan_table: str, journal: str | None = None
) -> DataFrame:
    """The same for promotion requests: log, registry, deployment and governance events. A request is known by model,
    version, both environments and run."""
    registry, deployments = spark.table(f"{schema}.{REGISTRY}"), spark.table(f"{schema}.{DEPLOYMENTS}")

    def derive(plan: DataFrame) -> dict[str, DataFrame]:
        events = {
            PROMOTIONS: lc.promotion_log_events(plan),
            REGISTRY: lc.promotion_status_events(plan, registry),
            DEPLOYMENTS: lc.promotion_deployment_events(plan, deployments),
            GOVERNANCE: lc.promotion_governance_events(plan),
        }
        return {table: _timed(rows, as_of, env, project) for table, rows in events.items()}

    folder, keys = _journal(spark, schema, "promotion", journal), [*lc.MODEL, "source_env", "target_env", "run_id"]
    found = decide_once(requests, folder, keys, lambda asked: lc.promotion_plan(asked, registry, deployments), derive)
    return _carry_out(*found, schema, plan_table)
