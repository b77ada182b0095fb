"""Run logs, lineage, scoring counts and readiness reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables the readiness report expects.
READINESS_TABLES = {
    "model_registry": "tb_model_registry",
    "model_deployments": "tb_model_deployments",
    "model_evaluation": "tb_model_evaluation",
    "confusion_matrix": "tb_model_confusion_matrix",
    "model_predictions": "tb_model_predictions",
    "prediction_monitoring": "tb_model_prediction_monitoring",
    "feature_monitoring": "tb_model_feature_monitoring",
    "drift_monitoring": "tb_model_drift_monitoring",
    "alert_events": "tb_ml_alert_events",
    "smoke_runs": "tb_ml_smoke_runs",
    "governance_runs": "tb_ml_governance_runs",
    "postprod_metrics": "tb_model_postprod_metrics",
    "retraining_requests": "tb_model_retraining_requests",
}
STAGES = ("knowledge", "chunks", "embeddings", "index", "rag_eval")


def smoke_report(stage_counts: DataFrame, group: Sequence[str] = ("project",)) -> DataFrame:
    """Stage counts (group, stage, row_count) as one row per group with presence checks and SUCCESS
    or FAILED; a missing stage counts 0."""
    counts = [
        F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("row_count"))), F.lit(0)).alias(f"{s}_count") for s in STAGES
    ]
    wide = stage_counts.groupBy(*group).agg(*counts)
    present = {f"{s}_present": F.col(f"{s}_count") > 0 for s in STAGES}
    smallest = F.least(*[F.col(f"{s}_count") for s in STAGES])
    return wide.withColumns({**present, "status": F.when(smallest > 0, "SUCCESS").otherwise("FAILED")})


def operational_report(stage_counts: DataFrame, group: Sequence[str] = ("project",)) -> DataFrame:
    """Chunk, embedding and index counts with the rounded embedding coverage and OK or WARN."""
    wide = smoke_report(stage_counts, group).select(*group, "chunks_count", "embeddings_count", "index_count")
    ratio = F.round(F.col("embeddings_count") / F.col("chunks_count"), 4)
    covered = wide.withColumn("embedding_coverage", F.when(F.col("chunks_count") > 0, ratio).otherwise(0.0))
    return covered.withColumn("status", F.when(F.col("embedding_coverage") >= 1.0, "OK").otherwise("WARN"))


def catalog_inventory(spark: SparkSession, schema: str) -> DataFrame:
    """Tables of a schema as ``table_name`` rows (empty when the schema is missing)."""
    if not spark.catalog.databaseExists(schema):
        return spark.createDataFrame([], "table_name STRING")
    return spark.sql(f"SHOW TABLES IN {schema}").select(F.col("tableName").alias("table_name"))


def readiness_checks(inventory: DataFrame, expected: Mapping[str, str] = READINESS_TABLES) -> DataFrame:
    """One row per expected table: does the inventory (``table_name``) hold it?"""
    arms = [arm for name, table in expected.items() for arm in (F.lit(name), F.lit(table))]
    wanted = inventory.sparkSession.range(1).select(F.stack(F.lit(len(expected)), *arms).alias("check_name", "table_name"))
    present = inventory.select("table_name").distinct().withColumn("__present", F.lit(True))
    return wanted.join(present, "table_name", "left").select(
        "check_name", "table_name", F.col("__present").isNotNull().alias("is_ready")
    )


def readiness_report(inventory: DataFrame, expected: Mapping[str, str] = READINESS_TABLES) -> DataFrame:
    """Ready and expected table counts with the rounded score."""
    return readiness_checks(inventory, expected).agg(
        F.sum(F.col("is_ready").cast("bigint")).alias("ready_items"),
        F.count(F.lit(1)).alias("total_items"),
        F.round(F.avg(F.col("is_ready").cast("double")), 4).alias("readiness_score"),
    )


def run_summary(
    events: DataFrame, keys: Sequence[str] = ("component", "run_id"), timestamp: str = "event_timestamp"
) -> DataFrame:
    """One row per run from its STARTED and SUCCESS or ERROR events: status, times, duration, message."""
    at = F.col(timestamp)
    ended = F.col("status").isin("SUCCESS", "ERROR")
    final = F.when(ended, F.struct(at, F.col("status"), F.col("message")))
    folded = events.groupBy(*keys).agg(
        F.min(F.when(F.col("status") == "STARTED", at)).alias("started_at"), F.max(final).alias("final")
    )
    seconds = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return (
        folded.select(
            *keys,
            "started_at",
            F.col(f"final.{timestamp}").alias("finished_at"),
            F.coalesce("final.status", F.lit("STARTED")).alias("status"),
            F.col("final.message").alias("message"),
        )
        .withColumn("duration_seconds", seconds)
    )


def lineage_edges(runs: DataFrame) -> DataFrame:
    """Parent to child edges of runs that name both a parent component and a parent run."""
    named = (F.coalesce("parent_component", F.lit("")) != "") & (F.coalesce("parent_run_id", F.lit("")) != "")
    return runs.filter(named).select(
        "parent_component",
        "parent_run_id",
        F.col("component").alias("child_component"),
        F.col("run_id").alias("child_run_id"),
    )


def scoring_counts(inputs: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Input and prediction counts per run; a run on one side only counts 0 on the other."""
    left = inputs.groupBy(*keys).agg(F.count(F.lit(1)).alias("input_count"))
    right = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("prediction_count"))
    joined = left.join(right, list(keys), "full_outer")
    return joined.select(
        *keys,
        F.coalesce("input_count", F.lit(0)).alias("input_count"),
        F.coalesce("prediction_count", F.lit(0)).alias("prediction_count"),
    )
