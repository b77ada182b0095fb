"""Prediction distributions and feature profiles."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.functions.rules import printed


def distinct_per_day(df: DataFrame, key: str, day: str, name: str) -> DataFrame:
    """Distinct keys per day (Spark de-duplicates (day, key) before counting)."""
    return df.groupBy(day).agg(F.countDistinct(key).alias(name))


def prediction_distribution(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Count and share per prediction value; NULL is a value of its own, empty input gives no rows.

    The total is a scalar subquery over the same grouped plan, so its shuffle is reused and no
    one-partition window is needed even when predictions are continuous.
    """
    counts = df.groupBy(F.col(prediction).cast("double").alias("prediction_value")).agg(
        F.count(F.lit(1)).alias("prediction_count")
    )
    total = counts.agg(F.sum("prediction_count")).scalar()
    return counts.withColumn("prediction_rate", F.col("prediction_count") / total)


def prediction_monitoring(df: DataFrame, target_env: str, prediction: str = "prediction") -> DataFrame:
    """The same distribution with the value as text (NULL prints as ``None``) and the environment."""
    rows = prediction_distribution(df, prediction)
    return rows.withColumns({"prediction_value": printed("prediction_value"), "target_env": F.lit(target_env)})


def confusion_matrix(
    df: DataFrame, label: str = "label", prediction: str = "prediction", weight: str | None = None
) -> DataFrame:
    """Record count by (label, prediction); ``weight`` sums a pre-aggregated count instead."""
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(
        F.col(label).cast("double").alias("actual_label"), F.col(prediction).cast("double").alias("predicted_label")
    ).agg(count.cast("bigint").alias("record_count"))


def constant_accuracy(df: DataFrame, label: str = "label", constant: float | None = 1.0) -> DataFrame:
    """Accuracy of always predicting ``constant``; NULL labels stay in the denominator, no rows give 0.

    ``constant=None`` predicts the most frequent non-NULL label (smallest on a tie).
    """
    if constant is None:
        counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
        hits = F.max(F.when(F.col(label).isNotNull(), F.col("n")))
        return counts.agg(F.coalesce(hits / F.sum("n"), F.lit(0.0)).alias("accuracy"))
    hit = F.when(F.col(label) == constant, 1.0).otherwise(0.0)
    return df.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"))


# ---- feature profiles: one unpivot into typed slots, one count, one fold ------------------------

SLOT_OF = {"float": "double", "tinyint": "bigint", "smallint": "bigint", "int": "bigint"}


def slot_type(data_type: T.DataType) -> str:
    """Type in which a column's values are counted; types without a wider one are slots of their own."""
    kind = data_type.simpleString()
    return SLOT_OF.get(kind, kind)


def slot_names(fields: Sequence[T.StructField]) -> dict[str, str]:
    """Column name of each slot type that the fields need, in the order of the types' names."""
    kinds = sorted({slot_type(f.dataType) for f in fields})
    return {kind: "v_" + re.sub(r"\W+", "_", kind).strip("_") for kind in kinds}


def known_fields(schema: T.StructType, columns: Sequence[str]) -> list[T.StructField]:
    wanted = set(columns)
    fields = [f for f in schema.fields if f.name in wanted]
    if not fields:
        raise ValueError("none of the feature columns exists in the input")
    return fields


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``feature_name``, one slot column per kind of value, and how many rows ``n`` hold the value (NULL: all
    slots are NULL).

    Every row is unpivoted once into (feature, slots); one shuffle counts all columns whatever their types. A
    value that fills a third of a column is one row per task before the shuffle. Counts of disjoint rows add up
    by :func:`merged_counts`, so they can be stored and extended.
    """
    fields = known_fields(df.schema, [c for c in columns if c not in by])
    slots = slot_names(fields)
    cells = []
    for f in fields:
        value = F.col("`" + f.name.replace("`", "``") + "`")
        cells.append(F.lit(f.name))
        cells += [(value if kind == slot_type(f.dataType) else F.lit(None)).cast(kind) for kind in slots]
    own = [F.col(f"`{c}`") for c in by]
    rows = df.select(*own, F.stack(F.lit(len(fields)), *cells).alias("feature_name", *slots.values()))
    return rows.groupBy(*own, "feature_name", *slots.values()).agg(F.count(F.lit(1)).alias("n"))


def merged_counts(counts: DataFrame) -> DataFrame:
    """Counts of several runs or days, added up per feature and value."""
    slots = [c for c in counts.columns if c.startswith("v_")]
    return counts.groupBy("feature_name", *slots).agg(F.sum("n").alias("n"))


def profile_counts(counts: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """Raw profile of the fields from their counted values (one row per feature and value)."""
    slots = slot_names(fields)
    missing = " AND ".join(f"{c} IS NULL" for c in slots.values())
    numbers = [c for kind, c in slots.items() if kind in ("double", "bigint") or kind.startswith("decimal")]
    number = f"coalesce({', '.join(f'CAST({c} AS DOUBLE)' for c in numbers)}, NULL)" if numbers else "CAST(NULL AS DOUBLE)"
    # the widest key a fold has: a feature's smallest and largest value in its own slot
    folded = counts.groupBy("feature_name").agg(
        *map(
            F.expr,
            (
                "sum(n) AS row_count",
                f"sum(IF({missing}, n, 0L)) AS null_count",
                f"count(IF({missing}, NULL, 1)) AS distinct_values",
                f"sum({number} * n) / sum(IF({number} IS NULL, NULL, n)) AS mean_value",
                *(f"{fold}({c}) AS {fold}_{c}" for c in slots.values() for fold in ("min", "max")),
            ),
        )
    )
    facts = [(f.name, f.dataType.simpleString(), isinstance(f.dataType, T.NumericType)) for f in fields]
    names = counts.sparkSession.createDataFrame(facts, "feature_name STRING, data_type STRING, is_numeric BOOLEAN")

    def text(fold: str) -> Column:
        found = F.lit(None).cast("string")
        for kind in sorted({f.dataType.simpleString() for f in fields}):
            slot = F.col(f"{fold}_{slots[SLOT_OF.get(kind, kind)]}")
            found = F.when(F.col("data_type") == kind, slot.cast(kind).cast("string")).otherwise(found)
        return found.alias(f"{fold}_value")

    return names.join(folded, "feature_name", "left").select(
        "feature_name",
        "data_type",
        "is_numeric",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("row_count", "null_count", "distinct_values")],
        F.coalesce(F.col("null_count") / F.col("row_count"), F.lit(0.0)).alias("null_rate"),
        F.when(F.col("is_numeric"), F.col("mean_value")).alias("mean_value"),
        text("min"),
        text("max"),
    )


def profile_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raw profile, one row per known column: counts, distinct non-NULL values, mean, min, max.

    One scan of the columns and two shuffles, of the counted values and of one row per feature and task.
    Several ``countDistinct`` in one aggregate would instead expand every row per column, and a job per
    column would scan once per column.
    """
    return profile_counts(value_counts(df, columns), known_fields(df.schema, columns))


def _null_value(profile: DataFrame) -> Column:
    return F.col("distinct_values") + F.when(F.col("null_count") > 0, 1).otherwise(0)


PROFILE_COLUMNS = (
    "feature_name", "data_type", "row_count", "null_count", "null_rate", "distinct_count",
    "mean_value", "min_value", "max_value",
)


def baseline_of(profile: DataFrame) -> DataFrame:
    """Baseline form of a raw profile: NULL counts as a distinct value, min and max for every type, nothing for
    empty input."""
    seen = profile.filter("row_count > 0")
    return seen.withColumn("distinct_count", _null_value(seen)).select(*PROFILE_COLUMNS)


def monitoring_of(profile: DataFrame) -> DataFrame:
    """Monitoring form: NULL is not a distinct value, min and max for numeric columns only, rows even for empty input."""
    numeric_only = [F.when(F.col("is_numeric"), F.col(c)).alias(c) for c in ("min_value", "max_value")]
    kept = [c for c in PROFILE_COLUMNS if c not in ("min_value", "max_value")]
    return profile.withColumnRenamed("distinct_values", "distinct_count").select(*kept, *numeric_only)


def feature_baseline(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return baseline_of(profile_columns(df, columns))


def feature_monitoring(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return monitoring_of(profile_columns(df, columns))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
