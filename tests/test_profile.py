"""Profiles: NULL rules, empty input, types, hot values."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeops.operators import drift, profile


def sample(spark):
    rows = [(1, 0.5, "b", True, None), (1, None, "a", False, None), (None, 0.5, None, True, None)]
    return spark.createDataFrame(rows, "i int, d double, s string, b boolean, n string")


def test_null_rules(spark):
    base = {r.feature_name: r for r in profile.feature_baseline(sample(spark), ["i", "d", "s", "b", "n", "missing"]).collect()}
    seen = {r.feature_name: r for r in profile.feature_monitoring(sample(spark), ["i", "d", "s", "b", "n"]).collect()}
    assert set(base) == set(seen) == {"i", "d", "s", "b", "n"}
    assert (base["i"].distinct_count, seen["i"].distinct_count) == (2, 1)
    assert (base["n"].distinct_count, seen["n"].distinct_count, base["n"].null_rate) == (1, 0, 1.0)
    assert (base["s"].min_value, base["s"].max_value, seen["s"].min_value) == ("a", "b", None)
    assert (base["b"].min_value, base["b"].mean_value) == ("false", None)
    assert (seen["i"].mean_value, seen["i"].min_value, seen["i"].data_type) == (1.0, "1", "int")


def test_empty_input(spark):
    empty = sample(spark).filter("false")
    assert profile.feature_baseline(empty, ["i", "s"]).count() == 0
    rows = profile.feature_monitoring(empty, ["i", "s"]).collect()
    assert [(r.row_count, r.null_rate, r.distinct_count) for r in rows] == [(0, 0.0, 0)] * 2
    assert profile.prediction_distribution(empty.withColumn("prediction", F.col("d"))).count() == 0
    assert profile.constant_accuracy(empty.withColumn("label", F.col("d"))).first().accuracy == 0.0


def test_other_types(spark):
    df = spark.sql("SELECT DATE '2024-01-02' AS d, TIMESTAMP '2024-01-02 03:04:05' AS t, CAST(1.50 AS DECIMAL(10,2)) AS m, CAST(0.1 AS FLOAT) AS f, array(1, 2) AS a, X'0A' AS x")
    rows = {r.feature_name: r for r in profile.feature_baseline(df, df.columns).collect()}
    assert rows["d"].min_value == "2024-01-02" and rows["t"].max_value == "2024-01-02 03:04:05"
    assert (rows["m"].mean_value, rows["m"].min_value, rows["f"].min_value) == (1.5, "1.50", "0.1")
    assert rows["a"].distinct_count == rows["x"].distinct_count == 1


def history(spark, rows):
    return spark.createDataFrame(rows, "model_name string, model_version string, event_timestamp int, run_id string, prediction_value double, prediction_rate double")


def test_latest_baseline(spark):
    rows = [("m", "v", 1, "a", 1.0, 0.7), ("m", "v", 2, "b", 1.0, 0.8), ("m", "v", 1, "a", 0.0, 0.2), ("m", "", 9, "z", 1.0, 0.1), ("m", None, 9, "z", 1.0, 0.1)]
    got = {r.prediction_value: r.prediction_rate for r in drift.latest_prediction_baseline(history(spark, rows)).collect()}
    assert got == {1.0: 0.8, 0.0: 0.2}


def test_prediction_drift_edges(spark):
    base = history(spark, [("m", "v", 1, "a", 1.0, 0.5), ("m", "v", 1, "a", None, 0.25), ("m", "v", 1, "a", 7.0, 0.25)])
    current = spark.createDataFrame([(1,), (1,), (2,), (None,)], "prediction int")
    got = {r.entity_name: (r.current_value, r.drift_status) for r in drift.prediction_drift(current, base, "m", "v").collect()}
    assert got == {"1.0": (0.5, "OK"), "2.0": (0.25, "BASELINE_MISSING"), "None": (0.25, "OK")}
    more = {r.entity_name: r.drift_status for r in drift.prediction_drift(current, base, "m", "v", include_vanished=True).collect()}
    assert more == {"1.0": "OK", "2.0": "BASELINE_MISSING", "None": "OK", "7.0": "CRITICAL"}
    empty = current.filter("false")
    assert drift.prediction_drift(empty, base, "m", "v", include_vanished=True).count() == 0
    missing = drift.prediction_drift(current, base, "m", None).collect()
    assert {r.drift_status for r in missing} == {"BASELINE_MISSING"}


def test_false_drift_of_nullable_feature(spark):
    df = sample(spark).select("i")
    base = profile.feature_baseline(df, ["i"]).withColumns({"model_name": F.lit("m"), "model_version": F.lit("v"), "event_timestamp": F.lit(1), "run_id": F.lit("r")})
    parity = {r.metric_name: r.drift_status for r in drift.feature_drift(df, ["i"], base, "m", "v").collect()}
    aligned = {r.metric_name: r.drift_status for r in drift.feature_drift(df, ["i"], base, "m", "v", null_safe_distinct=True).collect()}
    assert parity["distinct_count"] == "CRITICAL" and aligned["distinct_count"] == "OK"
    assert drift.feature_drift(df.filter("false"), ["i"], base, "m", "v").count() == 0


def test_hot_value(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v"))
    row = profile.feature_baseline(df, ["v"]).first()
    assert (row.row_count, row.distinct_count, row.min_value) == (60_000, 40_001, "-1")


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x")], "`a.b` int, `c d` string")
    assert {r.feature_name for r in profile.feature_baseline(df, ["a.b", "c d"]).collect()} == {"a.b", "c d"}


def test_one_scan_and_two_shuffles(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = profile.profile_columns(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_stored_counts_add_only_new_periods(spark):
    from lakeops.plans.profiles import add_value_counts, stored_profile

    rows = [("a", i % 7, i / 4, "x" if i % 3 else None, None) for i in range(50)] + [("b", 1, 0.5, "y", None)] * 20
    df = spark.createDataFrame(rows, "day string, i int, d double, s string, n date")
    spark.sql("CREATE SCHEMA IF NOT EXISTS profiled")
    names = ["i", "d", "s", "n"]
    add_value_counts(df.filter("day = 'a'"), names, F.col("day"), "profiled.counts")
    first = {r.partition for r in spark.sql("SHOW PARTITIONS profiled.counts").collect()}
    new = add_value_counts(df, names, F.col("day"), "profiled.counts")
    assert first == {"period=a"} and {r.period for r in new.collect()} == {"b"}
    assert add_value_counts(df, names, F.col("day"), "profiled.counts").count() == 0
    stored = spark.table("profiled.counts")
    for monitoring, whole in ((False, profile.feature_baseline), (True, profile.feature_monitoring)):
        got = stored_profile(stored, df, names, monitoring).collect()
        assert {tuple(r) for r in got} == {tuple(r) for r in whole(df, names).collect()}
    plan = stored_profile(stored.filter("period = 'b'"), df, names)._jdf.queryExecution().executedPlan().toString()
    assert "period = b" in plan.replace("#", " ").replace("(", " ") or "PartitionFilters: [isnotnull(period" in plan
    renamed = df.select(F.col("i").cast("string").alias("i"), "d", "s", "n", "day")
    try:
        add_value_counts(renamed.withColumn("day", F.lit("c")), ["i"], F.col("day"), "profiled.counts")
        raise AssertionError("other types must be refused")
    except ValueError:
        pass
