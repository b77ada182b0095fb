"""Prediction and feature drift with alerts, from scored rows to storable events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.operators.alerts import ALERT_KEY, alerts_from_drift
from lakeops.operators.drift import feature_drift, prediction_drift
from lakeops.operators.events import event_rows, newest
from lakeops.sources.tables import append_new_events

DRIFT_KEY = ("model_name", "model_version", "target_env", "run_id", "monitoring_type", "entity_name", "metric_name")


def prediction_drift_alerts(
    predictions: DataFrame,
    baseline: DataFrame,
    as_of,
    env: str,
    project: str,
    model_name: str,
    model_version: str,
    target_env: str,
    run_id: str,
    minimum: str = "WARNING",
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(drift events, alert events) of one model run."""
    rows = prediction_drift(predictions, baseline, model_name, model_version, **options)
    return _events(rows, as_of, env, project, model_name, model_version, target_env, run_id, minimum)


def feature_drift_alerts(
    features: DataFrame,
    columns: Sequence[str],
    baseline: DataFrame,
    as_of,
    env: str,
    project: str,
    model_name: str,
    model_version: str,
    target_env: str,
    run_id: str,
    minimum: str = "WARNING",
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(drift events, alert events) of one model run over its features."""
    rows = feature_drift(features, columns, baseline, model_name, model_version, **options)
    return _events(rows, as_of, env, project, model_name, model_version, target_env, run_id, minimum)


def _events(rows, as_of, env, project, model_name, model_version, target_env, run_id, minimum):
    drift = event_rows(
        rows, as_of, env, project, model_name=model_name, model_version=model_version, target_env=target_env, run_id=run_id
    )
    return drift, event_rows(alerts_from_drift(drift, minimum), as_of, env, project)


def store_drift(
    drift: DataFrame,
    as_of,
    env: str,
    project: str,
    model_name: str,
    run_id: str,
    minimum: str = "WARNING",
    drift_table: str = "tb_model_drift_monitoring",
    alert_table: str = "tb_ml_alert_events",
    emit_alerts: bool = True,
) -> None:
    """Append the drift events of one run, then the alerts raised from them.

    The alerts come from the written rows of the run, so the drift plan runs once. Rows whose key is
    stored already are left out: a run that is stored again after a failure ends with the same rows.
    """
    append_new_events(drift, "tb_model_drift_monitoring", DRIFT_KEY, newest("event_timestamp"), drift_table)
    if emit_alerts:
        mine = (F.col("run_id") == run_id) & (F.col("model_name") == model_name)
        stored = drift.sparkSession.table(drift_table).filter(mine)
        raised = event_rows(alerts_from_drift(stored, minimum), as_of, env, project)
        append_new_events(raised, "tb_ml_alert_events", ALERT_KEY, newest("event_timestamp"), alert_table)
