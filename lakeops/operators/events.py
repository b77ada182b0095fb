"""Append-only event tables: current-state folds, event rows, idempotent and keyed merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.sources.schemas import event_schema

RANK = "__rank"


def newest(column: str, *tie_breakers: str) -> list[Column]:
    """Descending order on a timestamp and its tie-breakers, for :func:`latest_by`."""
    return [F.col(c).desc_nulls_last() for c in (column, *tie_breakers)]


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int) -> DataFrame:
    """First ``count`` rows per key. Spark prunes to ``count`` per key before the shuffle
    (WindowGroupLimit), so a key that holds most rows does not reach one task whole."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(RANK, F.row_number().over(window)).filter(F.col(RANK) <= count).drop(RANK)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Current state: the first row per key in ``order``."""
    return top_by(df, keys, order, 1)


def event_rows(df: DataFrame, as_of, env: str, project: str, **fields) -> DataFrame:
    """Add the common event prefix and further columns; plain values become literals."""
    columns = {"event_timestamp": as_of, "env": env, "project": project, **fields}
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in columns.items()})


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select, cast and order the schema's columns; a NULL in a non-nullable one fails the write."""
    known = set(df.columns)
    out = []
    for field in schema.fields:
        if field.name in known:
            value = F.col(field.name).cast(field.dataType)
        elif field.nullable:
            value = F.lit(None).cast(field.dataType)
        else:
            raise ValueError(f"required column is missing: {field.name}")
        if not field.nullable:
            problem = F.raise_error(F.lit(f"NULL in required column {field.name}")).cast(field.dataType)
            value = F.coalesce(value, problem)
        out.append(value.alias(field.name))
    return df.select(*out)


def conform_events(df: DataFrame, table: str) -> DataFrame:
    """Rows of one of the fixed event tables."""
    return conform(df, event_schema(table))


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition on equally named keys that lets NULL meet NULL."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def new_events(
    incoming: DataFrame,
    existing: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    done: Column | None = None,
    unique_existing: bool = False,
) -> DataFrame:
    """Incoming events, one per key, whose key is not yet present among ``existing`` rows.

    ``done`` narrows the existing rows (for example to a SUCCESS status). Keys compare null-safe.
    Existing keys are made distinct first, so a hot key adds one row to the anti join;
    ``unique_existing`` saves that shuffle where the stored keys are known to be distinct.
    """
    seen = existing if done is None else existing.filter(done)
    seen = seen.select(*keys) if unique_existing else seen.select(*keys).distinct()
    fresh = latest_by(incoming, keys, order)
    return fresh.join(seen, null_safe(fresh, seen, keys), "left_anti")


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Target after a keyed merge: listed columns updated where matched, other source rows inserted.

    ``source`` holds one row per key. NULL keys never match. One full outer join, so each side is
    shuffled once.
    """
    updates = set(update_columns if update_columns is not None else [c for c in source.columns if c not in keys])
    src = source.select(
        *[F.col(k).alias(f"__s_{k}") for k in keys],
        *[F.col(c).alias(f"__s_{c}") for c in source.columns if c not in keys],
        F.lit(True).alias("__in_source"),
    )
    tgt = target.withColumn("__in_target", F.lit(True))
    condition = F.lit(True)
    for key in keys:
        condition = condition & (F.col(key) == F.col(f"__s_{key}"))
    joined = tgt.join(src, condition, "full_outer")
    out = []
    for name in target.columns:
        if name not in source.columns:
            out.append(F.col(name))
            continue
        incoming = F.col(f"__s_{name}")
        if name in keys:
            value = F.coalesce(F.col(name), incoming)
        elif name in updates:
            value = F.when(F.col("__in_source"), incoming).otherwise(F.col(name))
        else:
            value = F.when(F.col("__in_target"), F.col(name)).otherwise(incoming)
        out.append(value.alias(name))
    return joined.select(*out)
