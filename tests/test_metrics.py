"""Metrics against the ML library's evaluators and brute force."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from lakeops.operators import metrics, profile, reconcile
from lakeops.plans.evaluation import evaluate_tables

PAIR = "prediction double, label double, score double"


def test_multiclass_matches_evaluator(spark):
    rng = random.Random(1)
    rows = [(float(rng.choice([0, 1, 2, 5])), float(rng.choice([0, 1, 2, 3])), rng.random()) for _ in range(800)]
    df = spark.createDataFrame(rows, PAIR)
    got = metrics.classification_metrics(profile.confusion_matrix(df)).first()
    names = {"accuracy": "accuracy", "f1": "f1", "precision": "weightedPrecision", "recall": "weightedRecall"}
    for ours, theirs in names.items():
        assert got[ours] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs).evaluate(df), abs=1e-12)
    assert (got.support, got.null_pairs) == (800, 0)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 6), st.booleans()), min_size=2, max_size=60))
def test_auc_matches_pair_counting(spark, pairs):
    df = spark.createDataFrame([(0.0, float(y), float(s)) for s, y in pairs], PAIR)
    positive, negative = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    got = metrics.area_under_roc(df, ranges=3).first().auc
    if not positive or not negative:
        assert got is None
    else:
        wins = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
        assert got == pytest.approx(wins / (len(positive) * len(negative)), abs=1e-12)


def test_auc_matches_evaluator(spark):
    rng = random.Random(2)
    rows = [(0.0, float(rng.random() < 0.3), round(rng.random(), 3)) for _ in range(3000)]
    df = spark.createDataFrame(rows, PAIR)
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df)
    assert metrics.area_under_roc(df).first().auc == pytest.approx(theirs, abs=1e-12)


def test_null_pairs_and_empty(spark):
    df = spark.createDataFrame([(1.0, None, 0.1), (None, 1.0, 0.2), (1.0, 1.0, 0.3)], PAIR)
    got = metrics.classification_metrics(profile.confusion_matrix(df)).first()
    assert (got.support, got.null_pairs, got.accuracy) == (1, 2, 1.0)
    with pytest.raises(Exception, match="no record found"):
        metrics.classification_metrics(profile.confusion_matrix(df.filter("false"))).collect()


def hot_sides(spark):
    """One key holds a third of the rows on both sides."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    predictions = spark.range(3000).select(key.alias("k"), (F.col("id") % 2).cast("int").alias("prediction"), (F.col("id") % 7).cast("double").alias("score"))
    labels = spark.range(900).select(key.alias("k"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    return predictions, labels


def test_counted_join_equals_the_pairs(spark):
    predictions, labels = hot_sides(spark)
    pairs = reconcile.reconcile(predictions, labels, ["k"], score="score")
    expected = {(r.prediction, r.label, r.score): r.n for r in pairs.groupBy("prediction", "label", "score").agg(F.count("*").alias("n")).collect()}
    counted = reconcile.reconciled_counts(predictions, labels, ["k"], score="score").collect()
    assert {(r.prediction, r.label, r.score): r.record_count for r in counted} == expected
    assert sum(expected.values()) > 300_000
    predictions.createOrReplaceTempView("hot_predictions")
    labels.createOrReplaceTempView("hot_labels")
    got = {r.metric_name: r.metric_value for r in evaluate_tables(spark, "hot_predictions", "hot_labels", ["k"], [*metrics.METRICS, "auc"], score="score").collect()}
    assert got["support"] == sum(expected.values())
    assert got["accuracy"] == pytest.approx(MulticlassClassificationEvaluator(metricName="accuracy").evaluate(pairs), abs=1e-12)
    assert got["auc"] == pytest.approx(BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(pairs), abs=1e-12)


def test_reconcile_keys(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0, 0.5)], "k int, prediction double, label double, score double")
    with pytest.raises(ValueError):
        reconcile.reconcile(df, df, [])
    nulls = spark.createDataFrame([(None, 1)], "k int, prediction int")
    assert reconcile.reconcile(nulls, nulls.withColumnRenamed("prediction", "label"), ["k"]).count() == 0
