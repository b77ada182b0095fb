"""Alert queue jobs over the stored event table: planning and delivery outcomes as appended events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators.alerts import ALERT_KEY, AlertingConfig, alerts_with_status, delivery_outcomes, plan_notifications
from lakeops.operators.events import new_events, newest, null_safe
from lakeops.sources.tables import append_events, append_table

ALERTS = "tb_ml_alert_events"


def _at(df: DataFrame, as_of) -> DataFrame:
    return df.withColumn("event_timestamp", F.lit(as_of).cast("timestamp"))


def plan_pending(spark: SparkSession, table: str, config: AlertingConfig, as_of, plan_table: str) -> DataFrame:
    """Plan every pending alert: its channel entries are appended to ``plan_table`` (one row per alert
    and channel) for whoever delivers them, then its new status to the event table.

    Entries of earlier calls stay. Entries come first and only where they are not stored yet, so a call
    that stopped in between is finished by the next one. Returns the stored plan.
    """
    planned = plan_notifications(alerts_with_status(spark.table(table), "PENDING"), config)
    entries = (
        planned.filter(F.col("notification_status") == "PLANNED")
        .select(*ALERT_KEY, "severity", F.explode("notification_plan").alias("entry"))
        .select(*ALERT_KEY, "severity", "entry.*")
    )
    stored = spark.table(plan_table) if spark.catalog.tableExists(plan_table) else entries.limit(0)
    append_table(new_events(entries, stored, [*ALERT_KEY, "channel"], newest("severity")), plan_table)
    append_events(_at(planned, as_of), ALERTS, table)
    return spark.table(plan_table)


def record_outcomes(spark: SparkSession, table: str, deliveries: DataFrame, as_of, plan_table: str) -> None:
    """Append SENT or FAILED for every planned alert whose planned channels all have a result.

    ``deliveries`` has the alert key, channel, delivered_at, delivery_status and delivery_error. Alerts
    that still wait for a channel stay PLANNED and get no event.
    """
    waiting = alerts_with_status(spark.table(table), "PLANNED")
    plan = spark.table(plan_table).groupBy(*ALERT_KEY).agg(F.collect_set("channel").alias("planned_channels"))
    known = waiting.join(plan, null_safe(waiting, plan, ALERT_KEY), "left")
    known = known.select(*[waiting[c] for c in waiting.columns], plan["planned_channels"])
    outcomes = delivery_outcomes(known, deliveries, ALERT_KEY).filter(F.col("notification_status") != "PLANNED")
    append_events(_at(outcomes, as_of), ALERTS, table)
