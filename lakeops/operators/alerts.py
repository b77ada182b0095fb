"""Alert events, notification planning and delivery outcomes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.functions import rules
from lakeops.operators.events import latest_by, newest, null_safe

PLAN_TYPE = (
    "struct<channel:string,recipients:array<string>,subject:string,body:string,message:string,webhook_key:string>"
)
# How far each status is along the queue, for events of the same time.
STATUS_STEPS = {
    "PENDING": 0, "PLANNED": 1, "SKIPPED": 2, "NO_CHANNEL": 2, "NO_RECIPIENTS": 2, "FAILED": 2, "SENT": 2,
}
ALERT_KEY = ("model_name", "model_version", "run_id", "source_component", "metric_name", "entity_name")


@dataclass(frozen=True)
class AlertingConfig:
    """Alerting switches of one environment."""

    enable_alerting: bool = True
    email_enabled: bool = False
    slack_enabled: bool = False
    teams_enabled: bool = False
    recipients: str | None = None
    slack_webhook_key: str | None = None
    teams_webhook_key: str | None = None


def keep_alerting(df: DataFrame, minimum: str | None = "WARNING", status: str = "drift_status") -> DataFrame:
    """Rows whose normalised severity reaches the minimum."""
    return df.filter(rules.severity_rank(status) >= rules.minimum_rank(minimum))


def alert_message(model_name, model_version, metric_name, entity_name, severity, baseline, current) -> Column:
    """Message text of an alert; the entity part appears only for a non-empty entity."""
    entity = rules.as_column(entity_name)
    # Fixed value: message format.
    return F.concat(
        F.lit("Alerta de modelo: model_name="), rules.printed(model_name),
        F.lit(", model_version="), rules.printed(model_version),
        F.lit(", metric_name="), rules.printed(metric_name),
        F.when(F.coalesce(entity, F.lit("")) != "", F.concat(F.lit(", entity_name="), entity)).otherwise(""),
        F.lit(", severity="), rules.printed(severity),
        F.lit(", baseline_value="), rules.printed(baseline),
        F.lit(", current_value="), rules.printed(current),
    )


def alerts_from_drift(drift: DataFrame, minimum: str | None = "WARNING") -> DataFrame:
    """Drift rows at or above the minimum severity as PENDING alert events."""
    level = rules.severity("drift_status")
    return keep_alerting(drift, minimum).select(
        "model_name",
        "model_version",
        "run_id",
        F.lit("drift_monitoring").alias("source_component"),
        "metric_name",
        "entity_name",
        "baseline_value",
        "current_value",
        level.alias("severity"),
        alert_message(
            "model_name", "model_version", "metric_name", "entity_name", level, "baseline_value", "current_value"
        ).alias("message"),
        F.lit("PENDING").alias("notification_status"),
        F.lit(None).cast("string").alias("notification_error"),
    )


def clean_recipients(text) -> Column:
    """Non-blank trimmed addresses of a comma list; NULL gives none."""
    parts = F.transform(F.split(F.coalesce(rules.as_column(text), F.lit("")), ","), lambda a: F.trim(a))
    return F.filter(parts, lambda a: a != "")


def notification_plan(email, slack, teams, recipients, subject, message, slack_key, teams_key) -> Column:
    """One plan entry per enabled channel; e-mail only with at least one recipient."""
    none = F.lit(None).cast("string")
    nobody = F.lit(None).cast("array<string>")
    addresses = clean_recipients(recipients)

    def entry(channel: str, to, subject_text, body, text, key) -> Column:
        return F.struct(
            F.lit(channel).alias("channel"), to.alias("recipients"), subject_text.alias("subject"),
            body.alias("body"), text.alias("message"), key.alias("webhook_key"),
        ).cast(PLAN_TYPE)

    subject_text, text = rules.as_column(subject), rules.as_column(message)
    entries = F.array(
        F.when(rules.as_column(email) & (F.size(addresses) > 0), entry("email", addresses, subject_text, text, none, none)),
        F.when(rules.as_column(slack), entry("slack", nobody, none, none, text, rules.as_column(slack_key))),
        F.when(rules.as_column(teams), entry("teams", nobody, none, none, text, rules.as_column(teams_key))),
    )
    return F.filter(entries, lambda e: e.isNotNull())


def planning_status(enabled, plan) -> Column:
    """SKIPPED, NO_CHANNEL, NO_RECIPIENTS or PLANNED, first rule that applies."""
    items = rules.as_column(plan)
    unaddressed = F.exists(
        items, lambda e: (e["channel"] == "email") & (F.coalesce(F.size(e["recipients"]), F.lit(0)) <= 0)
    )
    return (
        F.when(~F.coalesce(rules.as_column(enabled), F.lit(True)), "SKIPPED")
        .when(F.coalesce(F.size(items), F.lit(0)) <= 0, "NO_CHANNEL")
        .when(unaddressed, "NO_RECIPIENTS")
        .otherwise("PLANNED")
    )


def plan_notifications(alerts: DataFrame, config: AlertingConfig) -> DataFrame:
    """Add ``notification_plan`` and the planning status to alert events."""
    subject = F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("model_name"), F.lit(" - "), F.col("metric_name"))
    plan = notification_plan(
        F.lit(config.email_enabled),
        F.lit(config.slack_enabled),
        F.lit(config.teams_enabled),
        F.lit(config.recipients).cast("string"),
        subject,
        "message",
        F.lit(config.slack_webhook_key).cast("string"),
        F.lit(config.teams_webhook_key).cast("string"),
    )
    planned = alerts.withColumn("notification_plan", plan)
    return planned.withColumn("notification_status", planning_status(F.lit(config.enable_alerting), "notification_plan"))


def alerts_with_status(alerts: DataFrame, status: str, keys: Sequence[str] | None = ALERT_KEY) -> DataFrame:
    """Events with a notification status, oldest first.

    ``keys`` first folds the append-only table to the newest event per alert, so an event that moved
    on is not read again; ``keys=None`` reads the rows as stored.
    """
    rows = alerts
    if keys:
        step = F.lit(-1)
        for status_name, number in STATUS_STEPS.items():
            step = F.when(F.col("notification_status") == status_name, number).otherwise(step)
        order = [*newest("event_timestamp"), step.desc(), F.col("notification_status").desc()]
        rows = latest_by(alerts, keys, order)
    return rows.filter(F.col("notification_status") == status).orderBy(F.col("event_timestamp").asc())


def delivery_outcomes(alerts: DataFrame, deliveries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fold per-channel delivery results into the events.

    A PLANNED event waits until every channel of its ``planned_channels`` (an array column; where it is
    missing or NULL, any one channel) has a result. It then becomes FAILED if any of them failed, SENT
    otherwise, NO_CHANNEL if no channel was planned; other events pass through. Each channel counts with
    its newest attempt.
    """
    # Rows of plain columns: the newest attempt as a struct takes more bytes in the shuffle.
    attempts = deliveries.select(*keys, "channel", "delivered_at", "delivery_status", "delivery_error")
    per_channel = latest_by(attempts, [*keys, "channel"], newest("delivered_at", "delivery_status", "delivery_error"))
    error = F.nullif(F.col("delivery_error"), F.lit(""))
    folded = per_channel.groupBy(*keys).agg(
        F.max(F.coalesce(F.col("delivery_status") == "FAILED", F.lit(False))).alias("__failed"),
        F.collect_set("channel").alias("__delivered"),
        F.sort_array(F.collect_list(F.when(error.isNotNull(), F.struct("channel", error.alias("e"))))).alias("__list"),
    )
    folded = folded.withColumn("__errors", F.array_join(F.transform("__list", lambda x: x["e"]), " | ")).drop("__list")
    planned = F.col("notification_status") == "PLANNED"
    wanted = F.col("planned_channels") if "planned_channels" in alerts.columns else F.lit(None).cast("array<string>")
    missing = F.size(F.array_except(wanted, F.coalesce("__delivered", F.array().cast("array<string>")))) > 0
    outcome = (
        F.when(F.size(wanted) == 0, "NO_CHANNEL")
        .when(F.coalesce(missing, F.lit(False)) | F.col("__failed").isNull(), "PLANNED")
        .when(F.col("__failed"), "FAILED")
        .otherwise("SENT")
    )
    done = planned & (outcome != "PLANNED")
    previous = F.col("notification_error") if "notification_error" in alerts.columns else F.lit(None).cast("string")
    events = alerts.withColumn("__previous_error", previous)
    joined = events.join(folded, null_safe(events, folded, keys), "left")
    return joined.select(
        *[events[c] for c in alerts.columns if c not in ("notification_status", "notification_error")],
        F.when(planned, outcome).otherwise(F.col("notification_status")).alias("notification_status"),
        F.when(done, F.nullif("__errors", F.lit(""))).otherwise(F.col("__previous_error")).alias("notification_error"),
    )


def apply_alert_rules(drift: DataFrame, alert_rules: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """Drift rows under their (model, metric) rule: rule thresholds replace the defaults, disabled
    rules and severities below the rule's minimum drop the row. Rows without a rule keep the defaults.
    Of repeated rules the first in ``order`` holds (default: largest values, column by column).
    """
    keys = ["model_name", "metric_name"]
    order = list(order) or newest(*[c for c in alert_rules.columns if c not in keys])
    joined = drift.drop("drift_status").join(latest_by(alert_rules, keys, order), keys, "left")
    status = rules.drift_status(
        "baseline_value",
        "relative_diff",
        F.coalesce("threshold_warning", F.lit(rules.DEFAULT_WARNING)),
        F.coalesce("threshold_critical", F.lit(rules.DEFAULT_CRITICAL)),
    )
    judged = joined.filter(F.coalesce("is_enabled", F.lit(True))).withColumn("drift_status", status)
    return judged.filter(rules.severity_rank("drift_status") >= rules.minimum_rank_column("severity_min"))
