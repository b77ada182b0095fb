"""Retraining requests, gates, cycle checks and retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.functions.rules import CRITICAL, as_column, cycle_key, printed
from lakeops.operators.events import latest_by, newest, null_safe

# Request vocabulary, transitions, cycle order, retained tables.
TRIGGER_TYPES = ("DRIFT", "POSTPROD_DEGRADATION", "MANUAL")
REQUEST_STATUSES = ("OPEN", "APPROVED", "REJECTED", "EXECUTED")
TRANSITIONS = (("OPEN", "APPROVED"), ("OPEN", "REJECTED"), ("APPROVED", "EXECUTED"))
CYCLE_ORDER = ("drift_cycle", "postprod_cycle", "retraining_cycle", "operational_cycle")
DEFAULT_RETENTION_DAYS = {
    "tb_model_predictions": 90,
    "tb_ml_alert_events": 180,
    "tb_model_postprod_metrics": 365,
    "tb_model_retraining_requests": 365,
    "tb_ml_governance_runs": 365,
    "tb_ml_smoke_runs": 180,
}
DEFAULT_MINIMA = {"accuracy": 0.70, "f1": 0.70, "precision": 0.70, "recall": 0.70}


@dataclass(frozen=True)
class Policy:
    """Switches and post-production minima of one environment."""

    minima: Mapping[str, float]
    open_on_drift: bool = False
    open_on_postprod: bool = False
    suggest_rollback: bool = False
    approve_drift: bool = False
    approve_postprod: bool = False


def metric_minimum(minima: Mapping[str, float], metric: str = "metric_name") -> Column:
    """Configured minimum of a metric; NULL for metrics without one."""
    result = F.lit(None).cast("double")
    for name, value in minima.items():
        result = F.when(F.col(metric) == name, float(value)).otherwise(result)
    return result


REQUEST_COLUMNS = (
    "model_name", "model_version", "trigger_type", "trigger_source", "trigger_severity",
    "reason", "request_status", "requested_by", "run_id",
)


def open_requests(df: DataFrame, **fields) -> DataFrame:
    """Rows as OPEN retraining requests; ``fields`` set request columns from Columns or literals.
    A trigger type outside the known ones fails."""
    columns = {k: v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()}
    known = set(df.columns) | set(columns)
    for name in REQUEST_COLUMNS:
        if name not in known:
            columns[name] = F.lit(None).cast("string")
    rows = df.withColumns({**columns, "request_status": F.lit("OPEN")})
    bad = F.raise_error(F.concat(F.lit("unknown trigger type: "), printed("trigger_type"))).cast("string")
    checked = F.when(F.col("trigger_type").isin(*TRIGGER_TYPES), F.col("trigger_type")).otherwise(bad)
    return rows.withColumn("trigger_type", checked).select(*REQUEST_COLUMNS)


def requests_from_alerts(alerts: DataFrame, policy: Policy, requested_by: str | None = None) -> DataFrame:
    """Requests from CRITICAL alerts, if the policy opens on drift."""
    wanted = alerts.filter((F.col("severity") == CRITICAL) & F.lit(policy.open_on_drift))
    return open_requests(
        wanted,
        trigger_type="DRIFT",
        trigger_source="drift_monitoring",
        trigger_severity=F.col("severity"),
        reason=F.col("message"),
        requested_by=F.lit(requested_by).cast("string"),
    )


def postprod_breaches(metrics: DataFrame, minima: Mapping[str, float]) -> DataFrame:
    """Metric rows strictly below their configured minimum, with ``threshold_value``."""
    judged = metrics.withColumn("threshold_value", metric_minimum(minima))
    return judged.filter(F.col("metric_value") < F.col("threshold_value"))


def requests_from_metrics(metrics: DataFrame, policy: Policy, requested_by: str | None = None) -> DataFrame:
    """Requests from metrics below their minimum, if the policy opens on degradation."""
    wanted = postprod_breaches(metrics, policy.minima).filter(F.lit(policy.open_on_postprod))
    # Fixed value: reason text.
    reason = F.concat(
        F.lit("Postprod metric abaixo do threshold: "), F.col("metric_name"), F.lit("="), printed("metric_value"),
        F.lit(", threshold="), printed("threshold_value"),
    )
    return open_requests(
        wanted,
        trigger_type="POSTPROD_DEGRADATION",
        trigger_source="postprod_evaluation",
        trigger_severity=CRITICAL,
        reason=reason,
        requested_by=F.lit(requested_by).cast("string"),
    )


def rollback_suggestions(metrics: DataFrame, policy: Policy) -> DataFrame:
    """Metric rows with ``suggest_rollback``."""
    minimum = metric_minimum(policy.minima)
    below = F.coalesce(F.col("metric_value") < minimum, F.lit(False))
    return metrics.withColumn("suggest_rollback", below & F.lit(policy.suggest_rollback))


def auto_approvals(requests: DataFrame, policy: Policy) -> DataFrame:
    """APPROVED events for CRITICAL requests of triggers the policy approves by itself."""
    enabled = F.when(F.col("trigger_type") == "DRIFT", F.lit(policy.approve_drift)).when(
        F.col("trigger_type") == "POSTPROD_DEGRADATION", F.lit(policy.approve_postprod)
    )
    wanted = requests.filter(F.coalesce(enabled, F.lit(False)) & (F.col("trigger_severity") == CRITICAL))
    return wanted.withColumn("request_status", F.lit("APPROVED"))


def allowed_transition(current: str, new: str) -> Column:
    pairs = [f"{a}>{b}" for a, b in TRANSITIONS]
    both = F.col(current).isNotNull() & F.col(new).isNotNull()
    return both & F.concat_ws(">", F.col(current), F.col(new)).isin(*pairs)


def judge_transitions(
    changes: DataFrame, requests: DataFrame, keys: Sequence[str] = ("model_name", "model_version", "run_id")
) -> DataFrame:
    """Requested status changes with the stored ``previous_status`` and whether they are allowed.

    ``changes`` has the keys and ``new_status``. A key without stored events has no previous status
    and is never allowed.
    """
    tie = [c for c in ("event_id", "request_status") if c in requests.columns]
    current = latest_by(requests, keys, newest("event_timestamp", *tie)).select(
        *keys, F.col("request_status").alias("previous_status")
    )
    joined = changes.join(current, null_safe(changes, current, keys), "left")
    rows = joined.select(*[changes[c] for c in changes.columns], "previous_status")
    return rows.withColumn("is_allowed", F.coalesce(allowed_transition("previous_status", "new_status"), F.lit(False)))


def executable_requests(requests: DataFrame, keys: Sequence[str] = ("model_name", "model_version", "run_id")) -> DataFrame:
    """Requests whose newest status is APPROVED."""
    tie = [c for c in ("event_id", "request_status") if c in requests.columns]
    return latest_by(requests, keys, newest("event_timestamp", *tie)).filter(F.col("request_status") == "APPROVED")


def executed_requests(requests: DataFrame, trained: DataFrame, keys: Sequence[str] = ("model_name", "model_version", "run_id")) -> DataFrame:
    """EXECUTED events of approved requests, with the ``new_model_version`` trained for the key."""
    ready = executable_requests(requests, keys)
    joined = ready.join(trained, null_safe(ready, trained, keys), "inner")
    return joined.select(
        *[ready[c] for c in ready.columns if c != "request_status"],
        F.lit("EXECUTED").alias("request_status"),
        "new_model_version",
    )


def retraining_gate(metrics: DataFrame, minima: Mapping[str, float], f1: str = "f1") -> DataFrame:
    """Gate on f1: no configured minimum passes, a NULL f1 fails."""
    minimum = F.lit(minima.get("f1")).cast("double")
    approved = minimum.isNull() | F.coalesce(F.col(f1) >= minimum, F.lit(False))
    text = F.concat(
        F.lit("f1="), printed(f1), F.when(approved, F.lit(" atende threshold=")).otherwise(" abaixo do threshold="),
        printed(minimum),
    )
    return metrics.withColumns({"gate_name": F.lit("post_retraining"), "approved": approved, "reason": text})


def rollback_gate(
    rollbacks: DataFrame,
    smoke_runs: DataFrame,
    keys: Sequence[str] = ("model_name", "model_version"),
    require_smoke: bool = True,
) -> DataFrame:
    """Gate on a successful smoke run of the version rolled back to."""
    done = smoke_runs.filter(F.col("status") == "SUCCESS").select(*keys).distinct().withColumn("__done", F.lit(True))
    joined = rollbacks.join(done, null_safe(rollbacks, done, keys), "left")
    approved = F.col("__done").isNotNull() | F.lit(not require_smoke)
    reason = F.when(approved, "Smoke validado apos rollback").otherwise("Smoke obrigatorio apos rollback ainda nao validado")
    return joined.select(
        *[rollbacks[c] for c in rollbacks.columns],
        F.lit("post_rollback").alias("gate_name"),
        approved.alias("approved"),
        reason.alias("reason"),
    )


def with_cycle_key(df: DataFrame) -> DataFrame:
    """Add ``execution_key`` from cycle, model, version, window and severity."""
    key = cycle_key("cycle_name", "model_name", "model_version", "window_start", "window_end", "severity")
    return df.withColumn("execution_key", key)


def cycle_order_check(runs: DataFrame, batch: str, cycle: str, timestamp: str) -> DataFrame:
    """Per batch: are exactly the four cycles present, first occurrences in order?

    Works on the first time per cycle, so a batch with many runs stays an ordinary aggregation.
    """
    first = runs.groupBy(batch, cycle).agg(F.min(timestamp).alias("at"))
    times = [F.max(F.when(F.col(cycle) == name, F.col("at"))).alias(f"t{i}") for i, name in enumerate(CYCLE_ORDER)]
    unknown = F.max(F.when(F.col(cycle).isin(*CYCLE_ORDER), 0).otherwise(1)).alias("unknown")
    folded = first.groupBy(batch).agg(*times, unknown)
    in_order = F.col("unknown") == 0
    for i in range(len(CYCLE_ORDER) - 1):
        in_order = in_order & (F.col(f"t{i}") < F.col(f"t{i + 1}"))
    return folded.select(batch, F.coalesce(in_order, F.lit(False)).alias("is_valid"))


def retention_split(
    df: DataFrame, days: int, as_of: datetime | Column, timestamp: str = "event_timestamp"
) -> tuple[DataFrame, DataFrame]:
    """(kept, expired) rows; NULL timestamps are kept."""
    limit = retention_limit(as_of, days)
    expired = F.col(timestamp) < limit
    return df.filter(F.col(timestamp).isNull() | (F.col(timestamp) >= limit)), df.filter(expired)


def retention_limit(as_of: datetime | Column, days) -> Column:
    start = as_of if isinstance(as_of, Column) else F.lit(as_of)
    length = days if isinstance(days, Column) else F.lit(days)
    return start - F.make_interval(days=length)


def retention_counts(
    rows: DataFrame,
    as_of: datetime | Column,
    retention: Mapping[str, int] = DEFAULT_RETENTION_DAYS,
    table: str = "table_name",
    timestamp: str = "event_timestamp",
) -> DataFrame:
    """Kept and expired row counts per table; a table without a rule keeps everything."""
    days = F.lit(None).cast("int")
    for name, value in retention.items():
        days = F.when(as_column(table) == name, value).otherwise(days)
    dated = rows.withColumn("retention_days", days)
    expired = F.coalesce(F.col(timestamp) < retention_limit(as_of, F.col("retention_days")), F.lit(False))
    return dated.groupBy(table, "retention_days").agg(
        F.sum(F.when(expired, 0).otherwise(1)).alias("kept_rows"),
        F.sum(F.when(expired, 1).otherwise(0)).alias("expired_rows"),
    )
