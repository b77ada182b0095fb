"""Retention on stored tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakeops.plans.retention import append_periods, apply_retention, period_end

START = datetime(2024, 1, 1)


def files(spark, table):
    rows = spark.table(table).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_modification_time").alias("t"))
    return {(r.p, r.t) for r in rows.distinct().collect()}


@pytest.mark.parametrize("period", ["day", "month"])
def test_only_the_partition_at_the_limit_is_rewritten(spark, period):
    table = f"kept_{uuid.uuid4().hex[:8]}"
    hours = list(range(0, 24 * 80, 6))
    rows = spark.createDataFrame([(h, START + timedelta(hours=h)) for h in hours] + [(-1, None)], "id int, event_timestamp timestamp")
    append_periods(rows, table, period=period)
    before = files(spark, table)
    as_of = datetime(2024, 3, 25, 6)
    for turn in range(2):
        report = apply_retention(spark, {table: 40}, as_of, period=period).first()
        limit = as_of - timedelta(days=40)
        kept = {h for h in hours if START + timedelta(hours=h) >= limit} | {-1}
        assert {r.id for r in spark.table(table).collect()} == kept
        assert report.rewritten == 1 and (report.dropped > 0) == (turn == 0)
    after = files(spark, table)
    assert len(after - before) == 1 and len(after & before) == len(after) - 1 > 1
    spark.sql(f"DROP TABLE {table}")


def test_a_limit_between_partitions_rewrites_none(spark):
    table = f"kept_{uuid.uuid4().hex[:8]}"
    rows = spark.createDataFrame([(d, START + timedelta(days=d, hours=5)) for d in range(6)], "id int, event_timestamp timestamp")
    append_periods(rows, table)
    before = files(spark, table)
    report = apply_retention(spark, {table: 2}, datetime(2024, 1, 5)).first()
    assert (report.dropped, report.rewritten) == (2, 0) and files(spark, table) < before
    report = apply_retention(spark, {table: 2}, datetime(2024, 1, 5, 12)).first()  # all rows of the day at the limit are older
    assert (report.dropped, report.rewritten) == (1, 0) and {r.id for r in spark.table(table).collect()} == {3, 4, 5}
    with pytest.raises(ValueError, match="unknown period"):
        append_periods(rows, table, period="week")
    assert period_end(datetime(2023, 12, 1).date(), "month") == datetime(2024, 1, 1)
    spark.sql(f"DROP TABLE {table}")
