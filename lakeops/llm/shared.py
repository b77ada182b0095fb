"""Written hand-over tables, folds and other small parts the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; the warehouse, shared as well, only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def handover(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write a step's rows to the shared folder once and go on from the files.

    Cuts the lineage: a lost executor only repeats the tasks of the step at hand. ``batch_rows`` bounds the Arrow batches
    of this step's Python functions, for rows that are large; the session's own setting is put back.
    """
    path = f"{scratch_root(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    conf, setting = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(setting)
    conf.set(setting, str(batch_rows) if batch_rows else before)
    try:
        df.write.parquet(path)
    finally:
        conf.set(setting, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
