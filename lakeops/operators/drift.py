"""Drift of prediction distributions and feature profiles against stored baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.functions import rules
from lakeops.operators.events import latest_by, newest
from lakeops.operators.profile import prediction_distribution, profile_columns

DRIFT_COLUMNS = (
    "monitoring_type", "entity_name", "metric_name", "baseline_value", "current_value",
    "absolute_diff", "relative_diff", "drift_status",
)


def with_drift(
    df: DataFrame,
    baseline: str = "baseline_value",
    current: str = "current_value",
    warning=rules.DEFAULT_WARNING,
    critical=rules.DEFAULT_CRITICAL,
) -> DataFrame:
    """Add absolute and relative difference and the drift status."""
    relative = rules.relative_diff(baseline, current)
    return df.withColumns(
        {
            "absolute_diff": rules.absolute_diff(baseline, current),
            "relative_diff": relative,
            "drift_status": rules.drift_status(baseline, relative, warning, critical),
        }
    )


def latest_prediction_baseline(baseline: DataFrame) -> DataFrame:
    """Newest baseline row per model, version and prediction value; versions must be non-empty."""
    known = baseline.filter(F.coalesce(F.col("model_version"), F.lit("")) != "")
    keys = ["model_name", "model_version", "prediction_value"]
    return latest_by(known, keys, newest("event_timestamp", "run_id"))


def latest_feature_baseline(baseline: DataFrame) -> DataFrame:
    """Newest baseline row per model, version and feature; versions must be non-empty."""
    known = baseline.filter(F.coalesce(F.col("model_version"), F.lit("")) != "")
    return latest_by(known, ["model_name", "model_version", "feature_name"], newest("event_timestamp", "run_id"))


def prediction_drift(
    predictions: DataFrame,
    baseline: DataFrame,
    model_name: str,
    model_version: str | None,
    prediction: str = "prediction",
    include_vanished: bool = False,
    warning: float = rules.DEFAULT_WARNING,
    critical: float = rules.DEFAULT_CRITICAL,
) -> DataFrame:
    """Share of each current prediction value against its newest baseline share.

    Values are matched null-safe as doubles. ``include_vanished`` adds baseline values that no longer
    occur (current share 0), as long as there is any current row.
    """
    mine = baseline.filter((F.col("model_name") == model_name) & (F.col("model_version") == F.lit(model_version)))
    base = latest_prediction_baseline(mine).select(
        F.col("prediction_value").alias("__value"), F.col("prediction_rate").alias("baseline_value")
    )
    current = prediction_distribution(predictions, prediction)
    how = "full_outer" if include_vanished else "left"
    joined = current.join(base, current["prediction_value"].eqNullSafe(base["__value"]), how)
    entity = F.col("prediction_value")
    rate = F.col("prediction_rate")
    if include_vanished:
        present = predictions.limit(1).select(F.lit(1)).exists()
        joined = joined.filter(rate.isNotNull() | present)
        entity = F.when(rate.isNull(), F.col("__value")).otherwise(entity)
        rate = F.coalesce(rate, F.lit(0.0))
    rows = joined.select(
        F.lit("prediction").alias("monitoring_type"),
        rules.printed(entity).alias("entity_name"),
        F.lit("prediction_rate").alias("metric_name"),
        "baseline_value",
        rate.alias("current_value"),
    )
    return with_drift(rows, warning=warning, critical=critical).select(*DRIFT_COLUMNS)


def feature_drift(
    features: DataFrame,
    columns: Sequence[str],
    baseline: DataFrame,
    model_name: str,
    model_version: str | None,
    null_safe_distinct: bool = False,
    warning: float = rules.DEFAULT_WARNING,
    critical: float = rules.DEFAULT_CRITICAL,
) -> DataFrame:
    """Drift of ``null_rate``, ``distinct_count`` and, for numeric columns, ``mean_value``.

    The baseline counts NULL as a distinct value and the current profile does not;
    ``null_safe_distinct`` aligns them. Empty input gives no rows.
    """
    mine = baseline.filter((F.col("model_name") == model_name) & (F.col("model_version") == F.lit(model_version)))
    base = latest_feature_baseline(mine).select(
        "feature_name",
        F.col("null_rate").cast("double").alias("b_null_rate"),
        F.col("distinct_count").cast("double").alias("b_distinct_count"),
        F.col("mean_value").cast("double").alias("b_mean_value"),
    )
    profile = profile_columns(features, columns).filter("row_count > 0")
    distinct = F.col("distinct_values")
    if null_safe_distinct:
        distinct = distinct + F.when(F.col("null_count") > 0, 1).otherwise(0)
    long = profile.join(base, "feature_name", "left").select(
        "feature_name",
        "is_numeric",
        F.stack(
            F.lit(3),
            F.lit("null_rate"), F.col("b_null_rate"), F.col("null_rate"),
            F.lit("distinct_count"), F.col("b_distinct_count"), distinct.cast("double"),
            F.lit("mean_value"), F.col("b_mean_value"), F.col("mean_value"),
        ).alias("metric_name", "baseline_value", "current_value"),
    )
    rows = long.filter(F.col("is_numeric") | (F.col("metric_name") != "mean_value")).select(
        F.lit("feature").alias("monitoring_type"),
        F.col("feature_name").alias("entity_name"),
        "metric_name",
        "baseline_value",
        "current_value",
    )
    return with_drift(rows, warning=warning, critical=critical).select(*DRIFT_COLUMNS)
