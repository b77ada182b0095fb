"""Fixed schemas of the append-only event tables, as Spark DDL."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names, types and nullability of every event table.
EVENT_PREFIX = "event_timestamp TIMESTAMP NOT NULL, env STRING NOT NULL, project STRING NOT NULL, "

EVENT_FIELDS = {
    "tb_model_baseline": "model_name STRING NOT NULL, model_version STRING NOT NULL, baseline_name STRING NOT NULL, "
    "metric_name STRING NOT NULL, metric_value DOUBLE, run_id STRING NOT NULL",
    "tb_model_prediction_baseline": "model_name STRING NOT NULL, model_version STRING NOT NULL, "
    "prediction_value DOUBLE, prediction_count BIGINT NOT NULL, prediction_rate DOUBLE, artifact_path STRING, "
    "run_id STRING NOT NULL",
    "tb_model_feature_baseline": "model_name STRING NOT NULL, model_version STRING NOT NULL, "
    "feature_name STRING NOT NULL, data_type STRING NOT NULL, row_count BIGINT NOT NULL, "
    "null_count BIGINT NOT NULL, null_rate DOUBLE, distinct_count BIGINT NOT NULL, mean_value DOUBLE, "
    "min_value STRING, max_value STRING, artifact_path STRING, run_id STRING NOT NULL",
    "tb_model_prediction_monitoring": "model_name STRING NOT NULL, model_version STRING, "
    "target_env STRING NOT NULL, run_id STRING NOT NULL, prediction_value STRING NOT NULL, "
    "prediction_count BIGINT NOT NULL, prediction_rate DOUBLE NOT NULL",
    "tb_model_feature_monitoring": "model_name STRING NOT NULL, model_version STRING, "
    "target_env STRING NOT NULL, run_id STRING NOT NULL, feature_name STRING NOT NULL, "
    "data_type STRING NOT NULL, row_count BIGINT NOT NULL, null_count BIGINT NOT NULL, "
    "null_rate DOUBLE NOT NULL, distinct_count BIGINT NOT NULL, mean_value DOUBLE, min_value STRING, "
    "max_value STRING",
    "tb_model_drift_monitoring": "model_name STRING NOT NULL, model_version STRING, target_env STRING NOT NULL, "
    "run_id STRING NOT NULL, monitoring_type STRING NOT NULL, entity_name STRING NOT NULL, "
    "metric_name STRING NOT NULL, baseline_value DOUBLE, current_value DOUBLE, absolute_diff DOUBLE, "
    "relative_diff DOUBLE, drift_status STRING NOT NULL",
    "tb_ml_alert_events": "model_name STRING NOT NULL, model_version STRING, run_id STRING NOT NULL, "
    "source_component STRING NOT NULL, metric_name STRING NOT NULL, entity_name STRING, baseline_value DOUBLE, "
    "current_value DOUBLE, severity STRING NOT NULL, message STRING, notification_status STRING NOT NULL, "
    "notification_error STRING",
    "tb_model_evaluation": "model_name STRING NOT NULL, model_version STRING NOT NULL, "
    "metric_name STRING NOT NULL, metric_value DOUBLE, run_id STRING NOT NULL",
    "tb_model_confusion_matrix": "model_name STRING NOT NULL, model_version STRING NOT NULL, "
    "actual_label DOUBLE, predicted_label DOUBLE, record_count BIGINT, run_id STRING NOT NULL",
    "tb_model_postprod_metrics": "model_name STRING NOT NULL, model_version STRING, metric_name STRING NOT NULL, "
    "metric_value DOUBLE, window_start STRING, window_end STRING, run_id STRING NOT NULL",
    "tb_model_retraining_requests": "model_name STRING NOT NULL, model_version STRING, "
    "trigger_type STRING NOT NULL, trigger_source STRING NOT NULL, trigger_severity STRING, reason STRING, "
    "request_status STRING NOT NULL, requested_by STRING, run_id STRING NOT NULL",
    "tb_model_registry": "model_name STRING NOT NULL, model_version STRING NOT NULL, algorithm STRING NOT NULL, "
    "run_id STRING NOT NULL, status STRING NOT NULL, artifact_path STRING",
    "tb_model_deployments": "model_name STRING NOT NULL, model_version STRING NOT NULL, "
    "artifact_path STRING NOT NULL, source_env STRING, target_env STRING NOT NULL, "
    "deployment_status STRING NOT NULL, is_active BOOLEAN NOT NULL, run_id STRING, notes STRING",
    "tb_model_scoring_runs": "model_name STRING NOT NULL, model_version STRING, target_env STRING NOT NULL, "
    "input_table STRING NOT NULL, output_table STRING NOT NULL, input_count BIGINT NOT NULL, "
    "prediction_count BIGINT NOT NULL, artifact_path STRING, run_id STRING NOT NULL",
    "tb_ml_smoke_runs": "component STRING NOT NULL, model_name STRING NOT NULL, model_version STRING, "
    "status STRING NOT NULL, input_table STRING, output_table STRING, run_id STRING NOT NULL, message STRING",
    "tb_ml_governance_runs": "component STRING NOT NULL, model_name STRING NOT NULL, model_version STRING, "
    "source_env STRING, target_env STRING, artifact_path STRING, status STRING NOT NULL, "
    "run_id STRING NOT NULL, message STRING",
    "tb_model_promotion_decision": "model_name STRING NOT NULL, model_version STRING NOT NULL, "
    "source_env STRING NOT NULL, target_env STRING, approved BOOLEAN NOT NULL, reason STRING NOT NULL, "
    "accuracy DOUBLE, f1 DOUBLE, auc DOUBLE, tests_passed BOOLEAN NOT NULL, manual_approval BOOLEAN NOT NULL, "
    "run_id STRING NOT NULL",
    "tb_ml_model_promotions": "model_name STRING NOT NULL, model_version STRING NOT NULL, "
    "artifact_path STRING NOT NULL, source_env STRING NOT NULL, target_env STRING NOT NULL, "
    "status STRING NOT NULL, reason STRING NOT NULL",
    "tb_model_deployment_contract": "model_name STRING NOT NULL, model_version STRING NOT NULL, "
    "source_env STRING NOT NULL, target_env STRING NOT NULL, target_cluster_key STRING NOT NULL, "
    "target_workspace_root STRING NOT NULL, target_timeout_seconds INT NOT NULL, "
    "target_max_retries INT NOT NULL, run_id STRING NOT NULL",
    "log_pipeline_runs": "component STRING NOT NULL, status STRING NOT NULL, run_id STRING NOT NULL, "
    "message STRING NOT NULL, duration_seconds DOUBLE",
    "log_pipeline_lineage": "parent_component STRING, parent_run_id STRING, child_component STRING, "
    "child_run_id STRING",
    "tb_sql_migration_history": "migration_type STRING NOT NULL, file_name STRING NOT NULL, "
    "file_path STRING NOT NULL, status STRING NOT NULL, message STRING NOT NULL, run_id STRING NOT NULL",
}

ALERT_RULES_DDL = (
    "alert_name STRING NOT NULL, is_enabled BOOLEAN NOT NULL, model_name STRING NOT NULL, "
    "metric_name STRING NOT NULL, severity_min STRING NOT NULL, threshold_warning DOUBLE, "
    "threshold_critical DOUBLE, email_enabled BOOLEAN NOT NULL, slack_enabled BOOLEAN NOT NULL, "
    "teams_enabled BOOLEAN NOT NULL, owner_group STRING, recipients STRING, webhook_url_key STRING, notes STRING"
)


def event_schema(table: str) -> T.StructType:
    """Schema of one event table, common prefix included (needs an active session)."""
    return T.StructType.fromDDL(EVENT_PREFIX + EVENT_FIELDS[table])


def alert_rules_schema() -> T.StructType:
    return T.StructType.fromDDL(ALERT_RULES_DDL)
