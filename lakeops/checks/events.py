"""Event tables, merges, run logs and readiness."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.checks.base import Tables, query, scratch_folder, scratch_schema, ts
from lakeops.operators import runs
from lakeops.operators.events import event_rows, new_events, newest, upsert
from lakeops.sources import tables as tb
from lakeops.sources.buckets import create_buckets, read_buckets, upsert_buckets

RUNS_SQL = """runs AS (SELECT event_type AS component, 'r' || user_id AS run_id, ts AS event_timestamp, event_id,
  CASE WHEN event_id % 5 < 2 THEN 'STARTED' WHEN event_id % 5 = 4 THEN 'ERROR' ELSE 'SUCCESS' END AS status,
  CASE WHEN event_id % 5 < 2 THEN 'Pipeline iniciado' WHEN event_id % 5 = 4 THEN 'ValueError: ' || event_id ELSE 'Pipeline finalizado com sucesso' END AS message FROM events)"""


def run_events(t: Tables) -> DataFrame:
    step = F.col("event_id") % 5
    return t.events.select(
        F.col("event_type").alias("component"),
        F.concat(F.lit("r"), "user_id").alias("run_id"),
        F.col("ts").alias("event_timestamp"),
        "event_id",
        F.when(step < 2, "STARTED").when(step == 4, "ERROR").otherwise("SUCCESS").alias("status"),
        F.when(step < 2, "Pipeline iniciado")
        .when(step == 4, F.concat(F.lit("ValueError: "), "event_id"))
        .otherwise("Pipeline finalizado com sucesso")
        .alias("message"),
    )


@query("s5_append_events", f"WITH {RUNS_SQL} SELECT component, status, run_id, message, event_timestamp, 'dev' AS env FROM runs")
def s5(t: Tables) -> DataFrame:
    name = f"{scratch_schema(t.spark)}.runs_{uuid.uuid4().hex[:8]}"
    rows = event_rows(run_events(t), F.col("event_timestamp"), "dev", "demo")
    for part in ("STARTED", "SUCCESS", "ERROR"):
        tb.append_events(rows.filter(F.col("status") == part), "log_pipeline_runs", name)
    stored = t.spark.table(name)
    return stored.select("component", "status", "run_id", "message", F.col("event_timestamp").cast("timestamp_ntz"), "env")


@query("s5_append_partitioned", "SELECT o_orderkey, o_orderstatus, o_custkey, o_orderpriority FROM orders")
def s5_partitioned(t: Tables) -> DataFrame:
    """Two appends to a table partitioned by a column in the middle."""
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority")
    name = f"{scratch_schema(t.spark)}.orders_{uuid.uuid4().hex[:8]}"
    for part in (rows.filter("o_orderkey % 2 = 0"), rows.filter("o_orderkey % 2 <> 0")):
        tb.append_table(part, name, ["o_orderstatus"])
    return t.spark.table(name).select(*rows.columns)


@query("s6_new_events", f"""WITH {RUNS_SQL}, seen AS (SELECT DISTINCT component, run_id FROM runs WHERE event_timestamp < TIMESTAMP '2024-01-10' AND status = 'SUCCESS'),
  incoming AS (SELECT * FROM runs WHERE event_timestamp >= TIMESTAMP '2024-01-10'
    QUALIFY row_number() OVER (PARTITION BY component, run_id ORDER BY event_timestamp DESC, event_id DESC) = 1)
  SELECT component, run_id, status, event_id FROM incoming ANTI JOIN seen USING (component, run_id)""")  # fmt: skip
def s6(t: Tables) -> DataFrame:
    rows = run_events(t)
    cut = F.col("event_timestamp") < ts("2024-01-10")
    fresh = new_events(
        rows.filter(~cut), rows.filter(cut), ["component", "run_id"], newest("event_timestamp", "event_id"), F.col("status") == "SUCCESS"
    )
    return fresh.select("component", "run_id", "status", "event_id")


UPSERT_SQL = """WITH source AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal, CAST('NEW' AS VARCHAR) AS c_mktsegment FROM
    (SELECT o_custkey + 500 AS o_custkey, o_totalprice FROM orders) GROUP BY 1)
  SELECT coalesce(c.c_custkey, s.c_custkey) AS c_custkey, c.c_name AS c_name, coalesce(s.c_acctbal, c.c_acctbal) AS c_acctbal,
  coalesce(c.c_mktsegment, s.c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN source s USING (c_custkey)"""


def upsert_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    target = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    source = (
        t.orders.groupBy((F.col("o_custkey") + 500).alias("c_custkey"))
        .agg(F.max("o_totalprice").alias("c_acctbal"))
        .withColumn("c_mktsegment", F.lit("NEW"))
    )
    return target, source


@query("s7_upsert", UPSERT_SQL)
def s7(t: Tables) -> DataFrame:
    target, source = upsert_sides(t)
    return upsert(target, source, ["c_custkey"], ["c_acctbal"])


@query("s7_upsert_table", UPSERT_SQL)
def s7_table(t: Tables) -> DataFrame:
    """The stored form, merged twice: the second time changes nothing."""
    target, source = upsert_sides(t)
    name = f"{scratch_schema(t.spark)}.customers_{uuid.uuid4().hex[:8]}"
    tb.overwrite_table(target, name)
    for _ in range(2):
        tb.upsert_table(t.spark, name, source, ["c_custkey"], ["c_acctbal"])
    return t.spark.table(name)


@query("s7_upsert_buckets", UPSERT_SQL)
def s7_buckets(t: Tables) -> DataFrame:
    """The bucketed form: two sources one after the other, which together are the source of the other queries."""
    target, source = upsert_sides(t)
    path = f"{scratch_folder(t.spark)}/customers-{uuid.uuid4().hex}"
    create_buckets(target, path, ["c_custkey"], 16)
    for part in (source.filter("c_custkey % 3 = 0"), source.filter("c_custkey % 3 > 0")):
        upsert_buckets(part, path, ["c_acctbal"])
    return read_buckets(t.spark, path)


STAGES_SQL = """stages AS (SELECT source AS project, 'knowledge' AS stage, count(*) AS row_count FROM documents GROUP BY 1
  UNION ALL SELECT source, 'chunks', count(*) FROM documents WHERE n_chars > 200 GROUP BY 1
  UNION ALL SELECT source, 'embeddings', count(*) FROM documents WHERE n_chars > 1000 AND lang <> 'de' GROUP BY 1
  UNION ALL SELECT source, 'index', count(*) FROM documents WHERE n_chars > 9000 GROUP BY 1
  UNION ALL SELECT source, 'rag_eval', count(*) FROM documents WHERE n_chars > 12000 GROUP BY 1),
  wide AS (SELECT project, """ + ", ".join(
    f"CAST(coalesce(sum(row_count) FILTER (stage = '{s}'), 0) AS BIGINT) AS {s}_count" for s in runs.STAGES
) + " FROM stages GROUP BY 1)"


def stage_counts(t: Tables) -> DataFrame:
    """All stages from one scan: one aggregate per source, unpivoted."""
    size = F.col("n_chars")
    hits = [F.lit(True), size > 200, (size > 1000) & (F.col("lang") != "de"), size > 9000, size > 12000]
    wide = t.documents.groupBy(F.col("source").alias("project")).agg(
        *[F.sum(F.when(h, 1).otherwise(0)).alias(s) for s, h in zip(runs.STAGES, hits)]
    )
    return wide.unpivot("project", list(runs.STAGES), "stage", "row_count")


@query("a8_smoke_report", f"WITH {STAGES_SQL} SELECT *, " + ", ".join(f"{s}_count > 0 AS {s}_present" for s in runs.STAGES)
       + ", CASE WHEN " + " AND ".join(f"{s}_count > 0" for s in runs.STAGES) + " THEN 'SUCCESS' ELSE 'FAILED' END AS status FROM wide")
def a8(t: Tables) -> DataFrame:
    return runs.smoke_report(stage_counts(t))


@query("a9_embedding_coverage", f"WITH {STAGES_SQL}, c AS (SELECT project, chunks_count, embeddings_count, index_count, "
       "CASE WHEN chunks_count > 0 THEN round(embeddings_count / chunks_count, 4) ELSE 0.0 END AS embedding_coverage FROM wide) "
       "SELECT project, chunks_count, embeddings_count, index_count, CAST(embedding_coverage AS DOUBLE) AS embedding_coverage, "
       "CASE WHEN embedding_coverage >= 1 THEN 'OK' ELSE 'WARN' END AS status FROM c")  # fmt: skip
def a9(t: Tables) -> DataFrame:
    return runs.operational_report(stage_counts(t))


EXPECTED_SQL = ", ".join(f"('{k}', '{v}')" for k, v in runs.READINESS_TABLES.items())
INVENTORY_SQL = f"""expected AS (SELECT * FROM (VALUES {EXPECTED_SQL}) v(check_name, table_name)),
  inventory AS (SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN 'tb_model_registry' WHEN 1 THEN 'tb_ml_alert_events' WHEN 2 THEN 'tb_model_predictions'
    WHEN 3 THEN 'tb_ml_smoke_runs' ELSE p_type END AS table_name FROM part)"""


def inventory(t: Tables) -> DataFrame:
    kind = F.col("p_size") % 5
    name = (
        F.when(kind == 0, "tb_model_registry").when(kind == 1, "tb_ml_alert_events").when(kind == 2, "tb_model_predictions")
        .when(kind == 3, "tb_ml_smoke_runs").otherwise(F.col("p_type"))
    )
    return t.part.select(name.alias("table_name"))


@query("a10_readiness", f"WITH {INVENTORY_SQL} SELECT CAST(count(i.table_name) AS BIGINT) AS ready_items, count(*) AS total_items, "
       "round(count(i.table_name) / count(*), 4) AS readiness_score FROM expected e LEFT JOIN inventory i USING (table_name)")  # fmt: skip
def a10(t: Tables) -> DataFrame:
    return runs.readiness_report(inventory(t))


@query("a10_readiness_checks", f"WITH {INVENTORY_SQL} SELECT e.check_name, e.table_name, i.table_name IS NOT NULL AS is_ready "
       "FROM expected e LEFT JOIN inventory i USING (table_name)")  # fmt: skip
def a10_checks(t: Tables) -> DataFrame:
    return runs.readiness_checks(inventory(t))


@query("a11_run_summary", f"""WITH {RUNS_SQL} SELECT component, run_id, min(event_timestamp) FILTER (status = 'STARTED') AS started_at,
  max(event_timestamp) FILTER (status <> 'STARTED') AS finished_at, coalesce(arg_max(status, event_timestamp) FILTER (status <> 'STARTED'), 'STARTED') AS status,
  arg_max(message, event_timestamp) FILTER (status <> 'STARTED') AS message,
  round((epoch_us(max(event_timestamp) FILTER (status <> 'STARTED')) - epoch_us(min(event_timestamp) FILTER (status = 'STARTED'))) / 1e6, 6) AS duration_seconds
  FROM runs GROUP BY 1, 2""")  # fmt: skip
def a11(t: Tables) -> DataFrame:
    rows = runs.run_summary(run_events(t))
    return rows.withColumn("duration_seconds", F.round("duration_seconds", 6) + 0.0)


@query("a12_lineage", "SELECT event_type AS parent_component, 'r' || user_id AS parent_run_id, 'child' AS child_component, 'c' || event_id AS child_run_id "
       "FROM events WHERE event_type <> 'view' AND user_id % 4 > 0")  # fmt: skip
def a12(t: Tables) -> DataFrame:
    requests = t.events.select(
        F.nullif("event_type", F.lit("view")).alias("parent_component"),
        F.when(F.col("user_id") % 4 > 0, F.concat(F.lit("r"), "user_id")).otherwise("").alias("parent_run_id"),
        F.lit("child").alias("component"),
        F.concat(F.lit("c"), "event_id").alias("run_id"),
    )
    return runs.lineage_edges(requests)


@query("a13_scoring_counts", """WITH i AS (SELECT o_custkey AS run_id, count(*) AS n FROM orders GROUP BY 1),
  p AS (SELECT l_suppkey * 7 AS run_id, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT run_id, coalesce(i.n, 0) AS input_count, coalesce(p.n, 0) AS prediction_count FROM i FULL JOIN p USING (run_id)""")  # fmt: skip
def a13(t: Tables) -> DataFrame:
    inputs = t.orders.select(F.col("o_custkey").alias("run_id"))
    outputs = t.lineitem.select((F.col("l_suppkey") * 7).alias("run_id"))
    return runs.scoring_counts(inputs, outputs)
