"""Reconciliation of predictions with later-arriving labels, and rule lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators.clean import time_window
from lakeops.operators.events import latest_by


def _windowed(df: DataFrame, timestamp: str | None, start, end) -> DataFrame:
    return time_window(df, timestamp, start, end) if timestamp else df


def reconcile(
    predictions: DataFrame,
    labels: DataFrame,
    keys: Sequence[str],
    prediction: str = "prediction",
    label: str = "label",
    prediction_timestamp: str | None = None,
    label_timestamp: str | None = None,
    start=None,
    end=None,
    score: str | None = None,
    dedupe_by: Sequence[Column] | None = None,
) -> DataFrame:
    """Keys with prediction and label as doubles (and the score, if named).

    Each side is windowed on its own timestamp, projected and inner-joined. Repeated keys multiply
    and NULL keys never match; ``dedupe_by`` keeps one label per key first.
    """
    if not keys:
        raise ValueError("at least one join key is required")
    left = _windowed(predictions, prediction_timestamp, start, end)
    right = _windowed(labels, label_timestamp, start, end)
    if dedupe_by:
        right = latest_by(right, keys, dedupe_by)
    extra = [F.col(score).cast("double").alias("score")] if score else []
    left = left.select(*keys, F.col(prediction).cast("double").alias("prediction"), *extra)
    right = right.select(*keys, F.col(label).cast("double").alias("label"))
    columns = [*keys, "prediction", "label", *(["score"] if score else [])]
    return left.join(right, list(keys), "inner").select(*columns)


def reconcile_tables(spark: SparkSession, predictions_table: str, labels_table: str, **options) -> DataFrame:
    """:func:`reconcile` over two catalog tables."""
    return reconcile(spark.table(predictions_table), spark.table(labels_table), **options)


def reconciled_counts(
    predictions: DataFrame,
    labels: DataFrame,
    keys: Sequence[str],
    prediction: str = "prediction",
    label: str = "label",
    prediction_timestamp: str | None = None,
    label_timestamp: str | None = None,
    start=None,
    end=None,
    score: str | None = None,
    unique_predictions: bool = False,
    unique_labels: bool = False,
) -> DataFrame:
    """(prediction, label[, score], record_count) of the reconciled pairs without building the pairs.

    Both sides are counted per key before the join and the counts multiplied after it, so a key that
    repeats on both sides contributes one joined row per value pair instead of its whole product. A
    side whose keys are known to be unique can skip its count, and with it one shuffle.
    """
    if not keys:
        raise ValueError("at least one join key is required")
    extra = [F.col(score).cast("double").alias("score")] if score else []
    values = ["prediction", *(["score"] if score else [])]

    def counted(df: DataFrame, columns: Sequence[str], name: str, unique: bool) -> DataFrame:
        if unique:
            return df.withColumn(name, F.lit(1).cast("bigint"))
        return df.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias(name))

    left = _windowed(predictions, prediction_timestamp, start, end).select(
        *keys, F.col(prediction).cast("double").alias("prediction"), *extra
    )
    right = _windowed(labels, label_timestamp, start, end).select(*keys, F.col(label).cast("double").alias("label"))
    joined = counted(left, values, "n_predictions", unique_predictions).join(
        counted(right, ["label"], "n_labels", unique_labels), list(keys), "inner"
    )
    return joined.groupBy(*values, "label").agg(F.expr("sum(n_predictions * n_labels) AS record_count"))


def with_baseline(current: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current metrics with their baseline columns; metrics without a baseline are kept, and NULL keys
    meet NULL keys.

    No broadcast hint: the baseline has one row per key, and Spark broadcasts it only if its measured
    size allows.
    """
    left, right = current.alias("current"), baseline.alias("baseline")
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"current.{key}").eqNullSafe(F.col(f"baseline.{key}"))
    extra = [F.col(f"baseline.{c}") for c in baseline.columns if c not in keys]
    return left.join(right, same, "left").select("current.*", *extra)


def with_rule(df: DataFrame, rules: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows with the first rule (in ``order``) of their key; rows without a rule are kept."""
    return df.join(latest_by(rules, keys, order), list(keys), "left")
