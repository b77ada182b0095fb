"""Headline queries on local[$BENCH_CPUS]; prints one JSON line. Times are second runs.

``reference_style`` holds the same work done the per-column, per-metric way, on the same data and
session, for comparison.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lakeops.checks import QUERIES  # noqa: E402
from lakeops.checks.base import Tables  # noqa: E402
from lakeops.checks.evaluation import WINDOWS, labels, predictions  # noqa: E402
from lakeops.checks.profiling import FEATURE_NAMES, features  # noqa: E402
from lakeops.operators.reconcile import reconcile  # noqa: E402
from lakeops.session import build_session  # noqa: E402

HEADLINE = [
    "a1_daily_distinct_customers", "a3_prediction_monitoring", "a4_feature_baseline", "a5_feature_monitoring",
    "d6_feature_drift", "d8_drift_with_alerts", "e5_area_under_roc", "e8_evaluate_tables", "j1_reconcile", "s7_upsert",
    "l8_delivery_outcome", "r8_rollback_plan", "r10_promotion_plan", "t5_transitions", "f1_consolidate",
    "f2_survivorship", "k2_document_report", "k4_chunks", "k7_embedding_rows", "k8_similar_chunks",
    "k9_hybrid_chunks", "k12_prompts", "g1_spec_audit",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def per_column_profile(t: Tables) -> None:
    """Row count, then three jobs per column."""
    df = features(t)
    df.count()
    for name in FEATURE_NAMES:
        df.filter(F.col(name).isNull()).count()
        df.select(name).distinct().count()
        numeric = df.schema[name].dataType.typeName() in ("double", "long", "integer")
        df.agg(F.min(name), F.max(name), *([F.avg(name)] if numeric else [])).collect()


def per_metric_evaluation(t: Tables) -> None:
    """Support count, then one evaluator run (one join) per metric."""
    df = reconcile(predictions(t), labels(t), score="score", **WINDOWS)
    df.count()
    for metric in ("accuracy", "f1", "weightedPrecision", "weightedRecall"):
        MulticlassClassificationEvaluator(metricName=metric).evaluate(df)
    BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(df)


def timed(work) -> float:
    work()
    start = time.time()
    work()
    return round(time.time() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    times = {name: timed(lambda name=name: run(QUERIES[name](spark, sf_dir))) for name in names}
    t = Tables(spark, sf_dir)
    style = {}
    if not wanted:
        style = {
            "a4_feature_baseline": timed(lambda: per_column_profile(t)),
            "e8_evaluate_tables": timed(lambda: per_metric_evaluation(t)),
        }
    print(
        json.dumps(
            {
                "metric": "total second-run time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "reference_style": style,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
