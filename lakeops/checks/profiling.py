"""Aggregation and profiling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.checks.base import Tables, flag, query, r6, scratch_schema, ts
from lakeops.operators import profile
from lakeops.plans.profiles import add_value_counts, stored_profile

SCORED_SQL = """scored AS (SELECT CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0.0 END AS prediction,
  CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0 END AS label,
  l_extendedprice AS score, l_shipdate AS ts FROM lineitem)"""

NULLABLE_SQL = """scored AS (SELECT nullif(l_linenumber, 7)::DOUBLE AS prediction,
  CASE l_returnflag WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN 0.0 END AS label FROM lineitem)"""


def scored(t: Tables) -> DataFrame:
    return t.lineitem.select(
        flag(F.col("l_discount") > 0.05).alias("prediction"),
        flag(F.col("l_returnflag") == "R").alias("label"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_shipdate").alias("ts"),
    )


def nullable_scored(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.nullif("l_linenumber", F.lit(7)).cast("double").alias("prediction"),
        F.when(F.col("l_returnflag") == "R", 1.0).when(F.col("l_returnflag") == "A", 0.0).alias("label"),
    )


# (name, SQL expression, SQL type name as Spark prints it, numeric)
FEATURES = [
    ("l_quantity", "l_quantity", "double", True),
    ("l_extendedprice", "l_extendedprice", "double", True),
    ("l_discount", "l_discount", "double", True),
    ("tax", "nullif(l_tax, 0)", "double", True),
    ("l_partkey", "l_partkey", "bigint", True),
    ("l_linenumber", "l_linenumber", "int", True),
    ("l_returnflag", "l_returnflag", "string", False),
    ("status", "nullif(l_linestatus, 'F')", "string", False),
    ("l_shipdate", "l_shipdate", "timestamp_ntz", False),
]
FEATURE_NAMES = [f[0] for f in FEATURES]


def features(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        F.nullif("l_tax", F.lit(0.0)).alias("tax"),
        "l_partkey",
        "l_linenumber",
        "l_returnflag",
        F.nullif("l_linestatus", F.lit("F")).alias("status"),
        "l_shipdate",
    )


def profile_sql(null_counts: bool, all_min_max: bool, where: str = "true", rounded: bool = True) -> str:
    parts = []
    for name, expr, kind, numeric in FEATURES:
        mean = f"avg({expr})" if numeric else "NULL"
        if rounded:
            mean = f"round({mean}, 5)"
        low, high = (f"CAST(min({expr}) AS VARCHAR)", f"CAST(max({expr}) AS VARCHAR)") if numeric or all_min_max else ("NULL", "NULL")
        extra = f" + CAST(count(*) > count({expr}) AS BIGINT)" if null_counts else ""
        rate = f"CASE WHEN count(*) = 0 THEN 0.0 ELSE (count(*) - count({expr})) / count(*) END"
        rate = f"round({rate}, 6)" if rounded else rate
        parts.append(
            f"SELECT '{name}' AS feature_name, '{kind}' AS data_type, count(*) AS row_count, "
            f"count(*) - count({expr}) AS null_count, CAST({rate} AS DOUBLE) AS null_rate, "
            f"count(DISTINCT {expr}){extra} AS distinct_count, CAST({mean} AS DOUBLE) AS mean_value, "
            f"{low} AS min_value, {high} AS max_value FROM lineitem WHERE {where}"
        )
    return " UNION ALL ".join(parts)


@query(
    "a1_daily_distinct_customers",
    "SELECT o_orderdate AS dt_referencia, count(DISTINCT o_custkey) AS qt_clientes FROM orders GROUP BY 1",
)
def a1(t: Tables) -> DataFrame:
    daily = profile.distinct_per_day(t.orders, "o_custkey", "o_orderdate", "qt_clientes")
    return daily.withColumnRenamed("o_orderdate", "dt_referencia")


@query(
    "a2_prediction_baseline",
    f"WITH {NULLABLE_SQL} SELECT prediction AS prediction_value, count(*) AS prediction_count, "
    "round(count(*) / (SELECT count(*) FROM scored), 6) AS prediction_rate FROM scored GROUP BY 1",
)
def a2(t: Tables) -> DataFrame:
    rows = profile.prediction_distribution(nullable_scored(t))
    return rows.select("prediction_value", "prediction_count", r6("prediction_rate"))


@query(
    "a3_prediction_monitoring",
    "SELECT coalesce(CAST(CAST(floor(value / 20) AS DOUBLE) AS VARCHAR), 'None') AS prediction_value, 'prd' AS target_env, "
    "count(*) AS prediction_count, round(count(*) / (SELECT count(*) FROM events), 6) AS prediction_rate "
    "FROM events GROUP BY 1",
)
def a3(t: Tables) -> DataFrame:
    rows = profile.prediction_monitoring(t.events.select(F.floor(F.col("value") / 20).alias("prediction")), "prd")
    return rows.select("prediction_value", "target_env", "prediction_count", r6("prediction_rate"))


@query("a4_feature_baseline", profile_sql(True, True))
def a4(t: Tables) -> DataFrame:
    rows = profile.feature_baseline(features(t), FEATURE_NAMES)
    return rows.withColumns({"null_rate": r6("null_rate"), "mean_value": F.round("mean_value", 5)})


def stored_counts(t: Tables) -> str:
    """Counts by year, stored by two runs: the second sees all rows and adds the years from 1997 on."""
    table = f"{scratch_schema(t.spark)}.counts_{uuid.uuid4().hex[:12]}"
    year = F.date_format("l_shipdate", "yyyy")
    for seen in (features(t).filter(F.col("l_shipdate") < ts("1997-01-01")), features(t)):
        add_value_counts(seen, FEATURE_NAMES, year, table)
    return table


@query("a4_stored_counts", profile_sql(True, True))
def a4_stored(t: Tables) -> DataFrame:
    rows = stored_profile(t.spark.table(stored_counts(t)), features(t), FEATURE_NAMES)
    return rows.withColumns({"null_rate": r6("null_rate"), "mean_value": F.round("mean_value", 5)})


@query("a5_stored_counts_window", profile_sql(False, False, "l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'"))
def a5_stored(t: Tables) -> DataFrame:
    two_years = t.spark.table(stored_counts(t)).filter(F.col("period").isin("1996", "1997"))
    rows = stored_profile(two_years, features(t), FEATURE_NAMES, monitoring=True)
    return rows.withColumns({"null_rate": r6("null_rate"), "mean_value": F.round("mean_value", 5)})


@query("a5_feature_monitoring", profile_sql(False, False))
def a5(t: Tables) -> DataFrame:
    rows = profile.feature_monitoring(features(t), FEATURE_NAMES)
    return rows.withColumns({"null_rate": r6("null_rate"), "mean_value": F.round("mean_value", 5)})


@query(
    "a6_confusion_matrix",
    f"WITH {NULLABLE_SQL} SELECT label AS actual_label, prediction AS predicted_label, count(*) AS record_count "
    "FROM scored GROUP BY 1, 2",
)
def a6(t: Tables) -> DataFrame:
    return profile.confusion_matrix(nullable_scored(t))


@query(
    "a7_constant_accuracy",
    f"WITH {NULLABLE_SQL} SELECT round(avg(CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy FROM scored",
)
def a7(t: Tables) -> DataFrame:
    return profile.constant_accuracy(nullable_scored(t)).select(r6("accuracy"))


@query(
    "a7_majority_accuracy",
    f"WITH {NULLABLE_SQL} SELECT round(max(n) FILTER (label IS NOT NULL) / sum(n), 6) AS accuracy "
    "FROM (SELECT label, count(*) AS n FROM scored GROUP BY 1)",
)
def a7_majority(t: Tables) -> DataFrame:
    return profile.constant_accuracy(nullable_scored(t), constant=None).select(r6("accuracy"))
