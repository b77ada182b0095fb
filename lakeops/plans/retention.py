"""Retention applied to stored tables: whole expired partitions are dropped, only the one at the limit is rewritten."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.plans.profiles import replace_partitions
from lakeops.sources.tables import append_table, stored

PERIODS = ("day", "month", "year")


def append_periods(df: DataFrame, table: str, timestamp: str = "event_timestamp", period: str = "day", column: str = "period_start") -> None:
    """Append rows to a table partitioned by the first day of their period; rows without a timestamp have a partition of their own."""
    _known(period)
    start = F.to_date(F.date_trunc(period, F.col(timestamp)))
    append_table(df.withColumn(column, start).repartition(column), table, [column])


def _known(period: str) -> None:
    if period not in PERIODS:
        raise ValueError(f"unknown period: {period}")


def period_end(start: date, period: str) -> datetime:
    """First moment behind a period."""
    if period == "day":
        after = start + timedelta(days=1)
    elif period == "month":
        after = date(start.year + start.month // 12, start.month % 12 + 1, 1)
    else:
        after = date(start.year + 1, 1, 1)
    return datetime(after.year, after.month, after.day)


def stored_starts(spark: SparkSession, table: str, column: str) -> list[date]:
    """Period starts of a table's partitions, from its partition list."""
    names = spark.sql(f"SHOW PARTITIONS {table}").select(F.regexp_extract("partition", rf"{column}=(\d{{4}}-\d\d-\d\d)", 1).alias("start"))
    return sorted(date.fromisoformat(r.start) for r in names.filter("start <> ''").distinct().collect())


def apply_retention(
    spark: SparkSession,
    days: Mapping[str, int],
    as_of: datetime,
    timestamp: str = "event_timestamp",
    period: str = "day",
    column: str = "period_start",
) -> DataFrame:
    """Remove the rows of each table that are older than its number of days, counted from ``as_of``.

    Tables are those of :func:`append_periods`. Partitions that ended before the limit are dropped without being read, the one
    the limit falls into is rewritten, all others keep their files; rows without a timestamp stay. Every step can be repeated,
    so a call that was stopped is simply made again. Returns (table_name, dropped, rewritten) partition counts.
    """
    _known(period)
    report = []
    for table, kept_days in days.items():
        limit = as_of - timedelta(days=kept_days)
        starts = stored_starts(spark, table, column)
        expired = [s for s in starts if period_end(s, period) <= limit]
        at_limit = [s for s in starts if datetime(s.year, s.month, s.day) < limit < period_end(s, period)]
        if at_limit:
            whole = spark.table(table).filter(F.col(column) == F.lit(at_limit[0]))
            kept = stored(whole.filter(F.col(timestamp) >= F.lit(limit).cast(whole.schema[timestamp].dataType)), "retained")
            if kept.isEmpty():
                expired, at_limit = [*expired, at_limit[0]], []
            else:
                replace_partitions(kept.select(*spark.table(table).columns), table)
        if expired:
            listed = ", ".join(f"PARTITION ({column} = DATE '{s.isoformat()}')" for s in expired)
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {listed}")
        report.append((table, len(expired), len(at_limit)))
    return spark.createDataFrame(report, "table_name STRING, dropped INT, rewritten INT")
