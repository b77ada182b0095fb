"""Prepare, train or reuse, evaluate, score: the model job of a customer set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators import datasets
from lakeops.operators.events import event_rows, newest
from lakeops.operators.metrics import METRICS, area_under_roc, classification_metrics, long_metrics
from lakeops.operators.profile import confusion_matrix
from lakeops.session import checkpoint_root
from lakeops.sources.tables import append_new_events, dataset_table, overwrite_run, stored

FEATURES = ("id_cliente", *datasets.CATEGORIES, *datasets.NUMBERS)


@dataclass(frozen=True)
class TrainingRun:
    model_version: str
    predictions: DataFrame
    metrics: DataFrame
    artifact_path: str


def model_path(spark: SparkSession, model_name: str, model_version: str, base: str | None = None) -> str:
    """``base/model/version``; the base defaults to the shared checkpoint folder."""
    root = base or f"{checkpoint_root(spark).rstrip('/')}/models"
    return f"{root.rstrip('/')}/{model_name}/{model_version}"


def train_and_score(
    spark: SparkSession,
    records: DataFrame,
    schema: str,
    model_name: str,
    model_version: str | None,
    run_id: str,
    as_of,
    env: str,
    project: str,
    skip_train: bool = False,
    base_path: str | None = None,
) -> TrainingRun:
    """Write the training set, train (or load the given version), evaluate on the test split, write
    the scoring set and its predictions, and log both ends of the smoke run.

    Both sets and the predictions are partitions of the run, and events are keyed by it: a repeated run replaces its
    own rows and leaves those of other runs alone. ``skip_train`` without a version is an error.
    """
    if skip_train and not model_version:
        raise ValueError("a model version is required when training is skipped")
    version = model_version or run_id

    def event(df: DataFrame, **fields) -> DataFrame:
        return event_rows(df, as_of, env, project, model_name=model_name, model_version=version, run_id=run_id, **fields)

    def record(rows: DataFrame, table: str, *keys: str) -> None:
        """A repeated run adds no rows that it stored before."""
        append_new_events(rows, table, ["model_name", "model_version", "run_id", *keys], newest("event_timestamp"), f"{schema}.{table}")

    training = f"{schema}.{dataset_table('training')}"
    consolidated = datasets.consolidate(records)
    overwrite_run(datasets.with_split(datasets.with_label(consolidated)), training, run_id)
    training_rows = spark.table(training).filter(F.col("run_id") == run_id)

    path = model_path(spark, model_name, version, base_path)
    if skip_train:
        model = PipelineModel.load(path)
    else:
        model = datasets.train_classifier(training_rows)
        model.write().overwrite().save(path)

    test = datasets.score_rows(model, training_rows.filter("dataset_split = 'test'"), ["label"])
    # One count per (label, prediction, score) serves the matrix and the ranking metric.
    counts = test.groupBy("label", "prediction", "score").agg(F.count(F.lit(1)).alias("record_count"))
    evaluated = stored(counts, "evaluation-counts")
    matrix = confusion_matrix(evaluated, weight="record_count")
    record(event(matrix), "tb_model_confusion_matrix", "actual_label", "predicted_label")
    auc = area_under_roc(evaluated, weight="record_count")
    metrics = long_metrics(classification_metrics(matrix), METRICS).unionByName(long_metrics(auc, ["auc"]))
    record(event(metrics), "tb_model_evaluation", "metric_name")

    scoring = f"{schema}.{dataset_table('scoring')}"
    overwrite_run(datasets.with_split(consolidated).select(*FEATURES, "status_final", "dataset_split"), scoring, run_id)
    output = f"{schema}.tb_model_predictions"

    def smoke(status: str) -> None:
        row = spark.range(1).select(F.lit("batch_inference").alias("component"), F.lit(status).alias("status"))
        tables = {"input_table": scoring, "output_table": output, "message": path}
        record(event(row, **tables), "tb_ml_smoke_runs", "component", "status")

    smoke("STARTED")
    label = F.when(F.col("status_final") == "ATIVO", 1.0).when(F.col("status_final") == "INATIVO", 0.0)
    keep = ["id_cliente", *datasets.CATEGORIES, "label", "dataset_split"]
    scored = datasets.score_rows(model, spark.table(scoring).filter(F.col("run_id") == run_id).withColumn("label", label), keep)
    overwrite_run(event(scored), output, run_id)
    smoke("SUCCESS")
    own = F.col("run_id") == run_id
    return TrainingRun(version, spark.table(output).filter(own), spark.table(f"{schema}.tb_model_evaluation").filter(own), path)
