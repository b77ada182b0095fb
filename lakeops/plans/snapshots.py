"""Stored current state: one row per key as of a point in time, so that a later read folds only the events behind it.

Layout below the snapshot's folder, which lies in shared storage: ``state/<n>`` holds the rows of snapshot ``n``, ``commits`` one
row per finished snapshot (its number and point in time). A snapshot without its commit row does not count and is
overwritten by the next one.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.operators.events import latest_by

COMMIT = "number INT, until TIMESTAMP_NTZ"


def newest_snapshot(events: DataFrame, path: str):
    """(number, until) of the newest finished snapshot, or None."""
    try:
        commits = events.sparkSession.read.schema(COMMIT).parquet(f"{path}/commits")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return commits.orderBy(F.desc("number")).first()


def state_and_tail(events: DataFrame, path: str, timestamp: str, lateness: timedelta) -> DataFrame:
    """Rows whose fold is the current state: the newest snapshot and the events from ``lateness`` before its point in time."""
    newest = newest_snapshot(events, path)
    if newest is None:
        return events
    state = events.sparkSession.read.schema(events.schema).parquet(f"{path}/state/{newest.number}")
    since = F.lit(newest.until - lateness).cast("timestamp_ntz").cast(events.schema[timestamp].dataType)
    return state.unionByName(events.filter(F.col(timestamp) >= since))


def current_state(
    events: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column], timestamp: str = "event_timestamp", lateness: timedelta = timedelta()
) -> DataFrame:
    """First row per key in ``order``, as a fold over all events would give it, from the newest snapshot and the tail.

    ``order`` starts with the newest ``timestamp``. The filter of the tail is pushed to the scan, so older files or partitions
    are not read. Events may arrive up to ``lateness`` after later ones were folded into a snapshot; what arrives later
    still is not seen before :func:`store_snapshot` is called with ``whole=True``.
    """
    return latest_by(state_and_tail(events, path, timestamp, lateness), keys, order)


def store_snapshot(
    events: DataFrame,
    path: str,
    keys: Sequence[str],
    order: Sequence[Column],
    until,
    timestamp: str = "event_timestamp",
    lateness: timedelta = timedelta(),
    whole: bool = False,
) -> int:
    """Store the state of all events before ``until`` (a datetime), built from the newest snapshot and the tail behind it; with
    ``whole`` from all events. Returns the snapshot's number. One writer at a time."""
    newest = newest_snapshot(events, path)
    if newest is not None and until < newest.until:
        raise ValueError(f"a snapshot until {newest.until} is stored")
    number = 0 if newest is None else newest.number + 1
    rows = events if whole else state_and_tail(events, path, timestamp, lateness)
    before = F.lit(until).cast("timestamp_ntz").cast(events.schema[timestamp].dataType)
    latest_by(rows.filter(F.col(timestamp) < before), keys, order).write.mode("overwrite").parquet(f"{path}/state/{number}")
    commit = events.sparkSession.createDataFrame([(number, until)], COMMIT)
    commit.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return number
