"""Post-production evaluation from prediction and label tables to long metric rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators.events import event_rows, newest
from lakeops.operators.metrics import METRICS, evaluate_pairs
from lakeops.operators.policy import Policy, requests_from_metrics
from lakeops.operators.reconcile import reconciled_counts
from lakeops.sources.tables import append_new_events

METRIC_KEY = ("model_name", "model_version", "metric_name", "window_start", "window_end", "run_id")
REQUEST_KEY = ("model_name", "model_version", "trigger_type", "trigger_source", "reason", "run_id")


def evaluate_tables(
    spark: SparkSession,
    predictions_table: str,
    labels_table: str,
    keys: Sequence[str],
    metric_names: Sequence[str] = METRICS,
    start=None,
    end=None,
    **options,
) -> DataFrame:
    """Metric rows with their window bounds.

    The pairs are never built: both tables are counted per key, joined once, and all metrics come
    from that one counted join. No reconciled pair at all is an error.
    """
    counts = reconciled_counts(
        spark.table(predictions_table), spark.table(labels_table), keys, start=start, end=end, **options
    )
    bounds = {"window_start": F.lit(start).cast("string"), "window_end": F.lit(end).cast("string")}
    return evaluate_pairs(counts, metric_names).withColumns(bounds)


def store_evaluation(
    metrics: DataFrame,
    policy: Policy,
    as_of,
    env: str,
    project: str,
    model_name: str,
    model_version: str | None,
    run_id: str,
    requested_by: str | None = None,
    metrics_table: str = "tb_model_postprod_metrics",
    requests_table: str = "tb_model_retraining_requests",
) -> None:
    """Append the metric rows of one run, then the retraining requests their values call for.

    The requests come from the written rows, so the evaluation runs once. Rows whose key is stored
    already are left out: a run that is stored again after a failure ends with the same rows.
    """
    version = F.lit(model_version).cast("string")
    rows = event_rows(metrics, as_of, env, project, model_name=model_name, model_version=version, run_id=run_id)
    append_new_events(rows, "tb_model_postprod_metrics", METRIC_KEY, newest("event_timestamp"), metrics_table)
    mine = (F.col("run_id") == run_id) & (F.col("model_name") == model_name)
    stored = metrics.sparkSession.table(metrics_table).filter(mine)
    opened = event_rows(requests_from_metrics(stored, policy, requested_by), as_of, env, project)
    append_new_events(opened, "tb_model_retraining_requests", REQUEST_KEY, newest("event_timestamp"), requests_table)
