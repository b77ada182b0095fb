"""Classification metrics from one confusion matrix, exact area under ROC, long metric rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("accuracy", "f1", "precision", "recall")


def classification_metrics(matrix: DataFrame) -> DataFrame:
    """One row: accuracy, support-weighted f1, precision and recall, support and NULL pairs.

    ``matrix`` has ``actual_label``, ``predicted_label``, ``record_count``. Pairs with a NULL side are
    left out and counted. No complete pair at all is an error.
    """
    complete = F.col("actual_label").isNotNull() & F.col("predicted_label").isNotNull()
    n = F.col("record_count")
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("actual_label") == F.col("predicted_label"), n).otherwise(zero)
    sides = F.stack(
        F.lit(2),
        F.col("actual_label"), n, zero, hit,
        F.col("predicted_label"), zero, n, zero,
    ).alias("c", "actual", "predicted", "hit")
    per_class = (
        matrix.select(complete.alias("ok"), sides)
        .groupBy(F.when(F.col("ok"), F.col("c")).alias("c"), "ok")
        .agg(*[F.sum(x).alias(x) for x in ("actual", "predicted", "hit")])
    )
    precision = F.when(F.col("predicted") > 0, F.col("hit") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("actual") > 0, F.col("hit") / F.col("actual")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    ok = F.col("ok")

    def weighted(value):
        return F.sum(F.when(ok, value * F.col("actual"))) / F.sum(F.when(ok, F.col("actual")))

    result = per_class.agg(
        F.coalesce(F.sum(F.when(ok, F.col("actual"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~ok, F.col("actual"))), F.lit(0)).alias("null_pairs"),
        (F.sum(F.when(ok, F.col("hit"))) / F.sum(F.when(ok, F.col("actual")))).alias("accuracy"),
        weighted(f1).alias("f1"),
        weighted(precision).alias("precision"),
        weighted(recall).alias("recall"),
    )
    empty = F.raise_error(F.lit("no record found for the evaluation")).cast("bigint")
    return result.withColumn("support", F.when(F.col("support") > 0, F.col("support")).otherwise(empty))


def area_under_roc(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    weight: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Exact area under ROC as one row ``auc`` (NULL without both classes).

    Rows are counted per distinct score, the scores range-partitioned, and each range ranked by
    itself; only one total per range meets in the last step. A label above 0.5 is positive.
    """
    spark = df.sparkSession
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = F.lit(1) if weight is None else F.col(weight)
    known = F.col(score).isNotNull()
    # Conditional sums instead of a filter: the filter would reach the inputs and make this branch
    # differ from other uses of the same counted rows, which then could not share their shuffles.
    counts = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(known & (F.col(label) > 0.5), n).otherwise(0)).cast("double").alias("p"),
        F.sum(F.when(known & (F.col(label) <= 0.5), n).otherwise(0)).cast("double").alias("q"),
    )
    ranged = counts.repartitionByRange(parts, "s").withColumn("part", F.spark_partition_id())
    below = F.sum("q").over(
        Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col("q")
    per_range = (
        ranged.withColumn("below", below)
        .groupBy("part")
        .agg(
            F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)).alias("inside"),
            F.sum("p").alias("p"),
            F.sum("q").alias("q"),
        )
    )
    # One row per range (a fixed number), so this window is small whatever the input size.
    earlier = F.sum("q").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = per_range.withColumn("earlier", F.coalesce(earlier, F.lit(0.0))).agg(
        F.sum(F.col("inside") + F.col("p") * F.col("earlier")).alias("wins"),
        (F.sum("p") * F.sum("q")).alias("pairs"),
    )
    return totals.select((F.col("wins") / F.nullif("pairs", F.lit(0.0))).alias("auc"))


def long_metrics(wide: DataFrame, metrics: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per metric: ``metric_name``, ``metric_value``."""
    arms = [arm for m in metrics for arm in (F.lit(m), F.col(m).cast("double"))]
    return wide.select(*keep, F.stack(F.lit(len(metrics)), *arms).alias("metric_name", "metric_value"))


def evaluate_pairs(counts: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Long metric rows, support included, from ``prediction``, ``label``, ``record_count``."""
    matrix = counts.groupBy(F.col("label").alias("actual_label"), F.col("prediction").alias("predicted_label")).agg(
        F.sum("record_count").alias("record_count")
    )
    wide = classification_metrics(matrix)
    rows = long_metrics(wide, [m for m in metrics if m in METRICS] + ["support"])
    if "auc" in metrics and "score" in counts.columns:
        auc = area_under_roc(counts, "score", "label", "record_count")
        rows = rows.unionByName(long_metrics(auc, ["auc"]))
    return rows
