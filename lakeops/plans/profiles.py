"""Stored value counts: a profile table that grows by whole periods and is never computed anew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators.profile import baseline_of, known_fields, merged_counts, monitoring_of, profile_counts, value_counts
from lakeops.sources.tables import ensure_schema

PERIOD = "period"


def stored_periods(spark: SparkSession, table: str) -> DataFrame | None:
    """Periods that the count table holds, from its partition list; None where there is no table yet."""
    if not spark.catalog.tableExists(table):
        return None
    return spark.sql(f"SHOW PARTITIONS {table}").select(F.regexp_extract("partition", f"^{PERIOD}=(.*)$", 1).alias(PERIOD)).distinct()


def replace_partitions(rows: DataFrame, table: str) -> None:
    """Overwrite the partitions that ``rows`` has and no others; the session's own overwrite mode is kept."""
    conf, name = rows.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    before = conf.get(name)
    conf.set(name, "dynamic")
    try:
        rows.write.insertInto(table, overwrite=True)
    finally:
        conf.set(name, before)


def add_value_counts(df: DataFrame, columns: Sequence[str], period: Column, table: str) -> DataFrame:
    """Count the values of every period of ``df`` that ``table`` does not hold yet and store each as a partition.

    ``period`` is text without ``/`` (a day, say); rows without one are left out. Only rows of new periods are
    counted. Partitions are replaced whole, so a call that was stopped and is repeated ends like one call. A
    period that is stored counts as complete. Returns the new counts as stored.
    """
    spark = df.sparkSession
    ensure_schema(spark, table)
    fields = known_fields(df.schema, columns)
    rows = df.select(*[F.col("`" + f.name.replace("`", "``") + "`") for f in fields], period.cast("string").alias(PERIOD)).filter(F.col(PERIOD).isNotNull())
    known = stored_periods(spark, table)
    if known is not None:
        rows = rows.join(known, PERIOD, "left_anti")
    counts = value_counts(rows, [f.name for f in fields], [PERIOD])
    counts = counts.select(*[c for c in counts.columns if c != PERIOD], PERIOD)
    if known is None:
        # an empty table first: its partitions are then written by the same statement in every call
        counts.limit(0).write.partitionBy(PERIOD).saveAsTable(table)
    elif [c for c in spark.table(table).columns] != counts.columns:
        raise ValueError(f"{table} counts columns of other types")
    replace_partitions(counts, table)
    return spark.table(table) if known is None else spark.table(table).join(known, PERIOD, "left_anti")


def stored_profile(counts: DataFrame, schema_of: DataFrame, columns: Sequence[str], monitoring: bool = False) -> DataFrame:
    """Profile of all periods in ``counts`` (rows of the count table, filtered by ``period`` as wanted).

    ``schema_of`` gives the columns' types. The source rows are not read: counts are added up over the periods and folded.
    """
    raw = profile_counts(merged_counts(counts), known_fields(schema_of.schema, columns))
    return monitoring_of(raw) if monitoring else baseline_of(raw)
