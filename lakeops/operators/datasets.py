"""Customer consolidation, survivorship, training sets and batch scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.operators.events import latest_by

CATEGORIES = ("segmento_dominante", "source_type_dominante")
NUMBERS = ("qtd_registros", "tem_file", "tem_table")
LABELS = {"ATIVO": 1.0, "INATIVO": 0.0}


def tag_source(df: DataFrame, source_type: str) -> DataFrame:
    return df.withColumn("source_type", F.lit(source_type))


def consolidate(records: DataFrame, key: str = "id_cliente") -> DataFrame:
    """One row per customer over all sources: most frequent segment and source (smallest on a tie),
    record count, source flags and the final status (ATIVO if any record is active, else the smallest).

    Records are counted per (customer, value) before they meet per customer, so that a customer with many
    records or many values never fills one buffer.
    """
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("segmento", "source_type")])
    counted = (
        records.select(key, "status", F.explode(kinds).alias("at"))
        .groupBy(key, "at.kind", "at.value")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("status") == "ATIVO", F.col("status"))).alias("active"), F.min("status").alias("least"))
    )
    is_source = F.col("kind") == "source_type"

    def dominant(kind: Column) -> Column:
        return F.min(F.when(kind & F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), "value")))["value"]

    return counted.groupBy(key).agg(
        dominant(~is_source).alias("segmento_dominante"),
        dominant(is_source).alias("source_type_dominante"),
        F.sum(F.when(is_source, F.col("n")).otherwise(0)).alias("qtd_registros"),
        F.max(F.when(is_source & (F.col("value") == "file"), 1).otherwise(0)).alias("tem_file"),
        F.max(F.when(is_source & (F.col("value") == "table"), 1).otherwise(0)).alias("tem_table"),
        F.coalesce(F.max("active"), F.min("least")).alias("status_final"),
    )


def survivorship(
    records: DataFrame, order: Sequence[Column], priority: Sequence[str] = ("table", "file"), key: str = "id_cliente"
) -> DataFrame:
    """One record per customer: first by source priority (unknown sources last), then by ``order``."""
    position = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("source_type"))
    ranked = records.withColumn("__priority", F.when(position > 0, position).otherwise(len(priority) + 1))
    return latest_by(ranked, [key], [F.col("__priority").asc(), *order]).drop("__priority")


def with_label(df: DataFrame, status: str = "status_final") -> DataFrame:
    """Add the numeric label and drop rows whose status has none."""
    label = F.lit(None).cast("double")
    for name, value in LABELS.items():
        label = F.when(F.col(status) == name, value).otherwise(label)
    return df.withColumn("label", label).filter(F.col("label").isNotNull())


def with_split(df: DataFrame, key: str = "id_cliente", modulo: int = 3, test_value: int = 0) -> DataFrame:
    """Deterministic split: ids with the test remainder are ``test``, all others ``train``."""
    remainder = F.pmod(F.col(key), F.lit(modulo))
    return df.withColumn("dataset_split", F.when(remainder == test_value, "test").otherwise("train"))


def status_classifier(
    categories: Sequence[str] = CATEGORIES, numbers: Sequence[str] = NUMBERS, iterations: int = 20
) -> Pipeline:
    """Index, encode and assemble the features, then a logistic regression on ``label``."""
    indexed = [f"{c}_index" for c in categories]
    encoded = [f"{c}_vector" for c in categories]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=list(categories), outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, handleInvalid="keep"),
            VectorAssembler(inputCols=[*encoded, *numbers], outputCol="features", handleInvalid="keep"),
            LogisticRegression(featuresCol="features", labelCol="label", maxIter=iterations),
        ]
    )


def train_classifier(df: DataFrame, **options) -> PipelineModel:
    """Fit on the ``train`` rows of a labelled, split dataset (returns a model, not rows)."""
    return status_classifier(**options).fit(df.filter(F.col("dataset_split") == "train"))


def score_rows(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Scored rows: kept columns, prediction and the score of the positive class."""
    scored = model.transform(df)
    positive = F.element_at(_vector_values("probability"), 2)
    return scored.select(*keep, F.col("prediction").cast("double").alias("prediction"), positive.alias("score"))


def _vector_values(column: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(column))
