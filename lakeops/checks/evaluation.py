"""Reconciliation and post-production evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.checks.base import Tables, flag, query, r6
from lakeops.checks.profiling import SCORED_SQL, scored
from lakeops.operators import metrics, profile, reconcile
from lakeops.operators.events import newest
from lakeops.plans.evaluation import evaluate_tables

START, END = "1996-01-01", "2000-01-01"

PAIRS_SQL = f"""predictions AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS prediction, o_totalprice AS score, o_orderdate AS ts FROM orders
    WHERE o_orderdate >= TIMESTAMP '{START}' AND o_orderdate < TIMESTAMP '{END}'),
  labels AS (SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_shipdate AS ts, l_linenumber AS n, l_partkey AS p FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '{START}' AND l_shipdate < TIMESTAMP '{END}'),
  pairs AS (SELECT id, CAST(prediction AS DOUBLE) AS prediction, CAST(label AS DOUBLE) AS label, score FROM predictions JOIN labels USING (id))"""

# Weighted metrics of any pair set with columns prediction and label.
METRICS_SQL = """classes AS (SELECT c, count(*) FILTER (label = c) AS actual, count(*) FILTER (prediction = c) AS predicted,
    count(*) FILTER (label = c AND prediction = c) AS hit
    FROM pairs, (SELECT DISTINCT label AS c FROM pairs UNION SELECT DISTINCT prediction FROM pairs) GROUP BY c),
  rates AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS p, CASE WHEN actual > 0 THEN hit / actual ELSE 0 END AS r FROM classes),
  wide AS (SELECT sum(hit) / sum(actual) AS accuracy, sum(actual * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / sum(actual) AS f1,
    sum(actual * p) / sum(actual) AS "precision", sum(actual * r) / sum(actual) AS recall, CAST(sum(actual) AS DOUBLE) AS support FROM rates)"""
SCORED_PAIRS_SQL = f"{SCORED_SQL}, pairs AS (SELECT prediction, label FROM scored)"

AUC_SQL = """ranked AS (SELECT label, avg(pos) OVER (PARTITION BY score) AS mid FROM (SELECT *, row_number() OVER (ORDER BY score) AS pos FROM pairs)),
  auc AS (SELECT (sum(mid) FILTER (label > 0.5) - count(*) FILTER (label > 0.5) * (count(*) FILTER (label > 0.5) + 1) / 2)
    / (count(*) FILTER (label > 0.5) * count(*) FILTER (label <= 0.5)) AS auc FROM ranked)"""


def predictions(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_totalprice") > 150000, 1).otherwise(0).alias("prediction"),
        F.col("o_totalprice").alias("score"),
        F.col("o_orderdate").alias("predicted_at"),
    )


def labels(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("id"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.col("l_shipdate").alias("labelled_at"),
        F.col("l_linenumber").alias("n"),
        F.col("l_partkey").alias("p"),
    )


WINDOWS = {
    "keys": ["id"], "prediction_timestamp": "predicted_at", "label_timestamp": "labelled_at", "start": START, "end": END
}


@query("j1_reconcile", f"WITH {PAIRS_SQL} SELECT id, prediction, label FROM pairs")
def j1(t: Tables) -> DataFrame:
    return reconcile.reconcile(predictions(t), labels(t), **WINDOWS)


@query("j1_reconcile_newest_label", f"WITH {PAIRS_SQL}, newest AS (SELECT * FROM labels QUALIFY row_number() OVER "
       "(PARTITION BY id ORDER BY ts DESC, n DESC, p DESC, label DESC) = 1) "
       "SELECT id, CAST(prediction AS DOUBLE) AS prediction, CAST(label AS DOUBLE) AS label, score FROM predictions JOIN newest USING (id)")  # fmt: skip
def j1_newest(t: Tables) -> DataFrame:
    order = newest("labelled_at", "n", "p", "label")
    return reconcile.reconcile(predictions(t), labels(t), score="score", dedupe_by=order, **WINDOWS)


@query("j2_reconcile_tables", f"WITH {PAIRS_SQL} SELECT id, prediction, label FROM pairs")
def j2(t: Tables) -> DataFrame:
    predictions(t).createOrReplaceTempView("lakeops_predictions")
    labels(t).createOrReplaceTempView("lakeops_labels")
    return reconcile.reconcile_tables(t.spark, "lakeops_predictions", "lakeops_labels", **WINDOWS)


def _metrics(t: Tables) -> DataFrame:
    return metrics.classification_metrics(profile.confusion_matrix(scored(t)))


def _register(name: str, metric: str) -> None:
    sql = f'WITH {SCORED_PAIRS_SQL}, {METRICS_SQL} SELECT round("{metric}", 6) AS "{metric}" FROM wide'
    query(name, sql)(lambda t: _metrics(t).select(r6(metric)))


for _name, _metric in (("e1_accuracy", "accuracy"), ("e2_f1", "f1"), ("e3_precision", "precision"), ("e4_recall", "recall")):
    _register(_name, _metric)


@query("e5_area_under_roc", f"WITH {SCORED_SQL}, pairs AS (SELECT label, score FROM scored), {AUC_SQL} SELECT round(auc, 6) AS auc FROM auc")
def e5(t: Tables) -> DataFrame:
    return metrics.area_under_roc(scored(t)).select(r6("auc"))


@query("e6_support", "SELECT count(*) FILTER (label IS NOT NULL) AS support, count(*) FILTER (label IS NULL) AS null_pairs FROM "
       "(SELECT CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS label FROM lineitem)")  # fmt: skip
def e6(t: Tables) -> DataFrame:
    kind = F.col("l_returnflag")
    rows = t.lineitem.select(
        F.when(kind == "R", 1.0).when(kind == "A", 0.0).alias("label"), flag(F.col("l_discount") > 0.05).alias("prediction")
    )
    return metrics.classification_metrics(profile.confusion_matrix(rows)).select("support", "null_pairs")


LONG_SQL = 'SELECT metric_name, round(metric_value, 6) AS metric_value FROM (UNPIVOT wide ON accuracy, f1, "precision", recall, support INTO NAME metric_name VALUE metric_value)'


@query("e7_long_metrics", f"WITH {SCORED_PAIRS_SQL}, {METRICS_SQL} {LONG_SQL}")
def e7(t: Tables) -> DataFrame:
    rows = metrics.long_metrics(_metrics(t), [*metrics.METRICS, "support"])
    return rows.select("metric_name", r6("metric_value"))


@query("e8_evaluate_tables", f"WITH {PAIRS_SQL}, {METRICS_SQL}, {AUC_SQL} SELECT metric_name, metric_value, '{START}' AS window_start, '{END}' AS window_end FROM ({LONG_SQL} UNION ALL SELECT 'auc', round(auc, 6) FROM auc)")
def e8(t: Tables) -> DataFrame:
    predictions(t).createOrReplaceTempView("lakeops_predictions")
    labels(t).createOrReplaceTempView("lakeops_labels")
    rows = evaluate_tables(
        t.spark, "lakeops_predictions", "lakeops_labels", metric_names=[*metrics.METRICS, "auc"], score="score",
        unique_predictions=True, **WINDOWS,
    )
    return rows.select("metric_name", r6("metric_value"), "window_start", "window_end")
