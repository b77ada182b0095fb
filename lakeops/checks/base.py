"""Registry of queries and their SQL, and lazy access to the driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.session import checkpoint_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPLIT = "2024-01-28"


class Tables:
    """``t.lineitem`` reads ``<sf_dir>/lineitem.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query function of :class:`Tables` under a name, with its SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def r6(column, name: str | None = None) -> Column:
    """Rounded to 6 digits for comparison; -0.0 is avoided by adding 0."""
    value = F.col(column) if isinstance(column, str) else column
    return (F.round(value, 6) + 0.0).alias(name or column)


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


_scratch: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder, or below the warehouse, shared as well, where
    that is unset; one per application."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        root = checkpoint_root(spark, spark.conf.get("spark.sql.warehouse.dir"))
        _scratch[app] = f"{root.rstrip('/')}/lakeops-{uuid.uuid4().hex}"
    return _scratch[app]


def scratch_schema(spark: SparkSession) -> str:
    """A schema of this application for queries whose feature is writing tables."""
    folder = scratch_folder(spark)
    name = "lakeops_" + folder.rsplit("-", 1)[1][:12]
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name} LOCATION '{folder}/tables'")
    return name
