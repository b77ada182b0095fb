"""Table scans and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators.events import conform_events, new_events, upsert
from lakeops.session import checkpoint_root

DATASET_VERSIONS = {
    ("training", "v1"): "tb_clientes_training_dataset",
    ("training", "v2"): "tb_clientes_training_dataset_v2",
    ("scoring", "v2"): "tb_clientes_scoring_dataset_v2",
}


def scan(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A catalog table, or a parquet path when the name has a slash."""
    df = spark.read.parquet(name) if "/" in name else spark.table(name)
    return df.select(*columns) if columns else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step's rows once to a fresh path of the shared folder and go on from the files."""
    spark = df.sparkSession
    root = checkpoint_root(spark, spark.conf.get("spark.sql.warehouse.dir"))
    path = f"{root.rstrip('/')}/lakeops-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scan_knowledge(
    spark: SparkSession, name: str, id_column: str, text_column: str, metadata_columns: Sequence[str] = ()
) -> DataFrame:
    """A document set mapped to ``document_id``, ``document_text`` and its metadata columns, in the splits of
    its files; a caller with few large files may repartition it."""
    return scan(spark, name, [id_column, text_column, *metadata_columns]).select(
        F.col(id_column).alias("document_id"), F.col(text_column).alias("document_text"), *metadata_columns
    )


def read_delimited(spark: SparkSession, path: str, schema: str, delimiter: str = ",") -> DataFrame:
    """Delimited text with a header and a declared schema (no inference pass)."""
    return spark.read.csv(path, schema=schema, header=True, sep=delimiter)


def split_delimited(lines: DataFrame, schema: str, column: str = "value", delimiter: str = ",") -> DataFrame:
    """The same for lines already held in a text column."""
    parsed = lines.select(F.from_csv(F.col(column), F.lit(schema), {"sep": delimiter}).alias("r"))
    return parsed.select("r.*")


def dataset_table(purpose: str, version: str = "v2", schema: str | None = None) -> str:
    """Name of the training or scoring dataset table of a version."""
    name = DATASET_VERSIONS.get((purpose, version))
    if name is None:
        raise ValueError(f"unsupported {purpose} dataset version: {version}")
    return f"{schema}.{name}" if schema else name


def stamp(df: DataFrame, as_of=None, columns: Sequence[str] = ("ingestion_date", "update_date")) -> DataFrame:
    """Add ingestion timestamps; ``as_of`` (literal or Column) fixes them."""
    value = F.current_timestamp() if as_of is None else as_of if isinstance(as_of, Column) else F.lit(as_of)
    return df.withColumns({c: value for c in columns})


def ensure_schema(spark: SparkSession, table: str) -> None:
    if "." in table:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {table.rsplit('.', 1)[0]}")


def overwrite_table(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> None:
    ensure_schema(df.sparkSession, table)
    df.write.mode("overwrite").partitionBy(*partition_by).saveAsTable(table)


def overwrite_run(df: DataFrame, table: str, value: str, run: str = "run_id") -> None:
    """Store the rows of run ``value`` in its own partition: a repeated run replaces its own rows, those of
    other runs stay. The partition is named in the statement, so the session's overwrite mode is no matter."""
    spark = df.sparkSession
    ensure_schema(spark, table)
    rows = df.withColumn(run, F.lit(value))
    if not spark.catalog.tableExists(table):
        rows.write.partitionBy(run).saveAsTable(table)
        return
    if [c.name for c in spark.catalog.listColumns(table) if c.isPartition] != [run]:
        raise ValueError(f"{table} is not partitioned by {run}")
    own = rows.select(*[c for c in spark.table(table).columns if c != run])
    text = value.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({run} = '{text}') SELECT * FROM {{own}}", own=own)


def append_table(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> None:
    """Create on the first write, append afterwards."""
    spark = df.sparkSession
    ensure_schema(spark, table)
    if spark.catalog.tableExists(table):
        # insertInto goes by position, and stored partition columns come last
        ordered = df.select(*spark.table(table).columns)
        ordered.write.mode("append").insertInto(table) if partition_by else df.write.mode("append").saveAsTable(table)
    else:
        df.write.mode("overwrite").partitionBy(*partition_by).saveAsTable(table)


def append_events(df: DataFrame, event_table: str, table: str | None = None) -> None:
    """Append rows of a fixed event table in one batch; the schema is enforced."""
    append_table(conform_events(df, event_table), table or event_table)


def append_new_events(
    df: DataFrame,
    event_table: str,
    keys: Sequence[str],
    order: Sequence[Column],
    table: str | None = None,
    done: Column | None = None,
) -> None:
    """Append only events whose key is not stored yet."""
    spark, name = df.sparkSession, table or event_table
    rows = conform_events(df, event_table)
    existing = spark.table(name) if spark.catalog.tableExists(name) else rows.limit(0)
    append_table(new_events(rows, existing, keys, order, done), name)


def upsert_table(
    spark: SparkSession,
    table: str,
    source: DataFrame,
    keys: Sequence[str],
    update_columns: Sequence[str] | None = None,
) -> None:
    """Keyed merge into a plain table: the result goes to a new table, then the names swap.

    The old table is dropped only after the new one carries its name. A call that was stopped between the
    two renames is mended first: the previous table gets its name back.
    """
    if not spark.catalog.tableExists(table) and spark.catalog.tableExists(f"{table}__previous"):
        spark.sql(f"ALTER TABLE {table}__previous RENAME TO {table}")
    if not spark.catalog.tableExists(table):
        overwrite_table(source, table)
        return
    merged, previous = f"{table}__merged", f"{table}__previous"
    spark.sql(f"DROP TABLE IF EXISTS {merged}")
    upsert(spark.table(table), source, keys, update_columns).write.saveAsTable(merged)
    spark.sql(f"DROP TABLE IF EXISTS {previous}")
    spark.sql(f"ALTER TABLE {table} RENAME TO {previous}")
    spark.sql(f"ALTER TABLE {merged} RENAME TO {table}")
    spark.sql(f"DROP TABLE {previous}")


def table_counts(tables: Mapping[str, DataFrame | None], spark: SparkSession) -> DataFrame:
    """(table_name, row_count) per given table; a missing one counts 0."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        if df is not None
        else spark.range(1).select(F.lit(name).alias("table_name"), F.lit(0).cast("bigint").alias("row_count"))
        for name, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
