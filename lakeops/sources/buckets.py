"""Tables in key buckets with a manifest of current generations: an upsert rewrites only the buckets it touches.

Layout below the table's folder, which lies in shared storage:

* ``data/generation=<g>/bucket=<b>``: rows of bucket ``b`` as written by the upsert that made generation ``g``;
* ``manifest/<g>``: for each bucket that holds rows, the generation to read it from, with the table's columns, keys and
  number of buckets;
* ``commits``: one row per finished upsert. The newest one names the manifest that readers follow.

An upsert writes data, then the manifest, then the commit row. Stopped anywhere before the last step it changes
nothing for readers, and the next upsert overwrites what it left. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.operators.events import upsert

BUCKET, GENERATION = "bucket", "generation"
MANIFEST = f"{BUCKET} INT, {GENERATION} INT, buckets INT, keys ARRAY<STRING>, columns STRING"
MOST_BUCKETS = 1 << 16  # the manifest has a row for each, and it is read by the driver


@dataclass(frozen=True)
class Manifest:
    """State of a table at one commit: ``places`` maps each bucket with rows to its generation."""

    generation: int
    buckets: int
    keys: tuple[str, ...]
    columns: T.StructType
    places: dict[int, int]

    def covers(self, wanted: Sequence[int] | None = None) -> Column:
        """Partition filter for the current rows, of all buckets or of the wanted ones."""
        by_generation: dict[int, list[int]] = {}
        for bucket, generation in self.places.items():
            if wanted is None or bucket in wanted:
                by_generation.setdefault(generation, []).append(bucket)
        found = F.lit(False)
        for generation, own in sorted(by_generation.items()):
            found = found | ((F.col(GENERATION) == generation) & F.col(BUCKET).isin(own))
        return found


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def create_buckets(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Store ``df`` as generation 0 of a new table. Choose ``buckets`` so that one fits a task comfortably (about 128 MB)."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"between 1 and {MOST_BUCKETS} buckets")
    if {BUCKET, GENERATION} & set(df.columns) or not set(keys) <= set(df.columns):
        raise ValueError(f"{BUCKET} and {GENERATION} are no column names here, and keys have to be columns")
    if newest_generation(df.sparkSession, path) is not None:
        raise ValueError(f"{path} holds a table already")
    _write(df, path, 0, Manifest(-1, buckets, tuple(keys), df.schema, {}))


def newest_generation(spark: SparkSession, path: str) -> int | None:
    try:
        return spark.read.schema(f"{GENERATION} INT").parquet(f"{path}/commits").agg(F.max(GENERATION)).first()[0]
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def manifest_of(spark: SparkSession, path: str) -> Manifest:
    generation = newest_generation(spark, path)
    if generation is None:
        raise ValueError(f"{path} holds no table")
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/{generation}").collect()  # at most MOST_BUCKETS
    columns = T.StructType.fromJson(json.loads(rows[0].columns))
    return Manifest(generation, rows[0].buckets, tuple(rows[0]["keys"]), columns, {r.bucket: r.generation for r in rows if r.bucket is not None})


def _rows(spark: SparkSession, path: str, manifest: Manifest, wanted: Sequence[int] | None = None) -> DataFrame:
    places = [T.StructField(GENERATION, T.IntegerType()), T.StructField(BUCKET, T.IntegerType())]
    stored = spark.read.schema(T.StructType([*manifest.columns.fields, *places])).parquet(f"{path}/data")
    return stored.filter(manifest.covers(wanted)).drop(GENERATION)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """Current rows, as of the newest commit; only the partitions the manifest names are read."""
    return _rows(spark, path, manifest_of(spark, path)).drop(BUCKET)


def _write(rows: DataFrame, path: str, generation: int, before: Manifest) -> None:
    spark = rows.sparkSession
    placed = rows.withColumn(BUCKET, bucket_of(before.keys, before.buckets))
    target = f"{path}/data/{GENERATION}={generation}"
    placed.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(target)
    written = spark.read.schema(f"{BUCKET} INT").option("basePath", target).parquet(target).select(BUCKET).distinct()
    places = before.places | {r.bucket: generation for r in written.collect()}  # at most MOST_BUCKETS
    same = (before.buckets, list(before.keys), before.columns.json())
    listed = [(b, g, *same) for b, g in places.items()] or [(None, None, *same)]
    spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{generation}")
    spark.createDataFrame([(generation,)], f"{GENERATION} INT").coalesce(1).write.mode("append").parquet(f"{path}/commits")


def upsert_buckets(source: DataFrame, path: str, update_columns: Sequence[str] | None = None) -> list[int]:
    """Merge ``source`` (one row per key) into the table and return the buckets it touched.

    Listed columns are updated where the key is stored, other source rows are inserted; NULL keys never match. Only
    the touched buckets are read, joined and written; an empty source changes nothing.
    """
    spark = source.sparkSession
    manifest = manifest_of(spark, path)
    placed = source.select(bucket_of(manifest.keys, manifest.buckets).alias(BUCKET)).distinct()
    touched = sorted(r.bucket for r in placed.collect())  # at most MOST_BUCKETS numbers
    if touched:
        current = _rows(spark, path, manifest, touched).drop(BUCKET)
        _write(upsert(current, source, manifest.keys, update_columns), path, manifest.generation + 1, manifest)
    return touched
