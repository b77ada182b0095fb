"""Scans, stamps, cleaning and layered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.checks.base import Tables, query, scratch_schema, ts
from lakeops.functions import rules
from lakeops.operators import clean, profile
from lakeops.plans.medallion import run_layers
from lakeops.sources import tables as tb

AS_OF = "2024-02-01"
CUSTOMERS_SQL = """customers AS (SELECT c_custkey AS id_cliente, '  ' || c_name || ' ' AS nome, lower(c_mktsegment) AS segmento,
  CASE WHEN c_acctbal > 0 THEN 'ativo' ELSE 'Inativo' END AS status, TIMESTAMP '2024-01-31' AS dt_ingestao FROM customer)"""
CONTACTS_SQL = """contacts AS (SELECT CAST(c_custkey AS VARCHAR) AS id_cliente_origem, ' ' || c_name AS nm_cliente,
  ' ' || replace(c_name, '#', '@') || '.COM ' AS ds_email, '(' || c_nationkey || ') ' || c_custkey || '-' || c_nationkey AS nr_telefone,
  '2024-01-31' AS dt_referencia FROM customer)"""


def customers(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("id_cliente"),
        F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("nome"),
        F.lower("c_mktsegment").alias("segmento"),
        F.when(F.col("c_acctbal") > 0, "ativo").otherwise("Inativo").alias("status"),
        ts("2024-01-31").alias("dt_ingestao"),
    )


def contacts(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").cast("string").alias("id_cliente_origem"),
        F.concat(F.lit(" "), "c_name").alias("nm_cliente"),
        F.concat(F.lit(" "), F.regexp_replace("c_name", "#", "@"), F.lit(".COM ")).alias("ds_email"),
        F.concat(F.lit("("), "c_nationkey", F.lit(") "), "c_custkey", F.lit("-"), "c_nationkey").alias("nr_telefone"),
        F.lit("2024-01-31").alias("dt_referencia"),
    )


@query("s1_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def s1(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("lakeops_orders")
    return tb.scan(t.spark, "lakeops_orders", ["o_orderkey", "o_custkey", "o_totalprice"])


@query("s3_delimited_text", """SELECT c_custkey AS id_cliente, c_name AS nome, c_mktsegment AS segmento,
  CASE WHEN c_acctbal > 0 THEN 'ATIVO' ELSE 'INATIVO' END AS status, 'file' AS source_type FROM customer""")  # fmt: skip
def s3(t: Tables) -> DataFrame:
    status = F.when(F.col("c_acctbal") > 0, "ATIVO").otherwise("INATIVO")
    lines = t.customer.select(F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment", status).alias("value"))
    rows = tb.split_delimited(lines, "id_cliente BIGINT, nome STRING, segmento STRING, status STRING")
    return rows.withColumn("source_type", F.lit("file"))


@query("s4_overwrite_layer", "SELECT c_custkey, c_mktsegment FROM customer")
def s4(t: Tables) -> DataFrame:
    name = f"{scratch_schema(t.spark)}.s4_customers"
    tb.overwrite_table(t.customer.select("c_custkey"), name)
    tb.overwrite_table(t.customer.select("c_custkey", "c_mktsegment"), name)
    return t.spark.table(name)


@query("s8_stamp", f"SELECT o_orderkey, TIMESTAMP '{AS_OF}' AS ingestion_date, TIMESTAMP '{AS_OF}' AS update_date FROM orders")
def s8(t: Tables) -> DataFrame:
    return tb.stamp(t.orders.select("o_orderkey"), ts(AS_OF))


@query("p1_standardize_customers", f"WITH {CUSTOMERS_SQL} SELECT id_cliente, trim(nome) AS nome, upper(segmento) AS segmento, "
       f"upper(status) AS status, dt_ingestao, TIMESTAMP '{AS_OF}' AS dt_processamento FROM customers")  # fmt: skip
def p1(t: Tables) -> DataFrame:
    return clean.standardize_customers(customers(t), ts(AS_OF))


@query("p2_standardize_contacts", f"WITH {CONTACTS_SQL} SELECT id_cliente_origem AS id_cliente, trim(nm_cliente) AS nm_cliente, "
       "lower(trim(ds_email)) AS ds_email, regexp_replace(nr_telefone, '[^0-9]', '', 'g') AS nr_telefone, dt_referencia, "
       f"TIMESTAMP '{AS_OF}' AS ingestion_date, TIMESTAMP '{AS_OF}' AS update_date FROM contacts")  # fmt: skip
def p2(t: Tables) -> DataFrame:
    return clean.standardize_contacts(contacts(t), ts(AS_OF))


GOLD_SQL = (
    f"WITH {CUSTOMERS_SQL} SELECT id_cliente, trim(nome) AS nome, upper(segmento) AS segmento, upper(status) AS status, "
    f"dt_ingestao, TIMESTAMP '{AS_OF}' AS dt_processamento FROM customers WHERE upper(status) = 'ATIVO'"
)


@query("p3_active_customers", GOLD_SQL)
def p3(t: Tables) -> DataFrame:
    return clean.active_customers(clean.standardize_customers(customers(t), ts(AS_OF)))


@query("p4_time_window", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' "
       "AND l_shipdate < TIMESTAMP '1999-07-01'")  # fmt: skip
def p4(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate")
    return clean.time_window(rows, "l_shipdate", "1997-01-01", "1999-07-01")


@query("p5_numeric_pair", "SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS prediction, CAST(substr(CAST(l_partkey AS VARCHAR), 1, 2) AS DOUBLE) AS label FROM lineitem")
def p5(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.substring(F.col("l_partkey").cast("string"), 1, 2).alias("text"))
    return clean.numeric_pair(rows, "l_linenumber", "text").select("l_orderkey", "prediction", "label")


BANDS = [(0.7, "alto"), (0.4, "medio")]


@query("p6_score_band", "WITH s AS (SELECT p_partkey, CASE WHEN p_size % 10 > 0 THEN p_size / 50 END AS vl_score FROM part) "
       "SELECT p_partkey, CASE WHEN vl_score IS NULL THEN NULL WHEN vl_score >= 0.7 THEN 'alto' WHEN vl_score >= 0.4 THEN 'medio' ELSE 'baixo' END AS ds_faixa_score FROM s")  # fmt: skip
def p6(t: Tables) -> DataFrame:
    score = F.when(F.col("p_size") % 10 > 0, F.col("p_size") / 50)
    return t.part.select("p_partkey", rules.score_band(score, BANDS, "baixo").alias("ds_faixa_score"))


@query("p7_dataset_version", "SELECT o_orderkey AS id_cliente FROM orders UNION ALL SELECT c_custkey FROM customer")
def p7(t: Tables) -> DataFrame:
    versions = {"v1": t.orders.select(F.col("o_orderkey").alias("id_cliente")), "v2": t.customer.select(F.col("c_custkey").alias("id_cliente"))}
    for version, rows in versions.items():
        rows.createOrReplaceTempView(tb.dataset_table("training", version))
    return profile.union_all([tb.scan(t.spark, tb.dataset_table("training", v)) for v in versions])


@query("p8_layered_run", GOLD_SQL)
def p8(t: Tables) -> DataFrame:
    return run_layers(t.spark, customers(t), scratch_schema(t.spark), ts(AS_OF), stamped=True)
