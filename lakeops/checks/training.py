"""F1-F8: consolidation, survivorship, training sets, model and scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.checks.base import Tables, query, scratch_folder, scratch_schema, ts
from lakeops.operators import clean, datasets
from lakeops.operators.events import newest
from lakeops.operators.profile import union_all
from lakeops.plans.training import train_and_score

RECORDS_SQL = """records AS (SELECT o_custkey AS id_cliente, o_orderpriority AS segmento, CASE o_orderkey % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'file' ELSE 'api' END AS source_type,
  CASE WHEN o_orderstatus = 'O' AND o_custkey % 3 > 0 THEN 'ATIVO' WHEN o_custkey % 11 = 5 THEN 'SUSPENSO' ELSE 'INATIVO' END AS status, o_orderdate AS ts, o_orderkey AS record_id FROM orders)"""
CONSOLIDATED_SQL = """seg AS (SELECT id_cliente, segmento AS segmento_dominante FROM (SELECT id_cliente, segmento, count(*) AS n FROM records GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY id_cliente ORDER BY n DESC, segmento) = 1),
  src AS (SELECT id_cliente, source_type AS source_type_dominante FROM (SELECT id_cliente, source_type, count(*) AS n FROM records GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY id_cliente ORDER BY n DESC, source_type) = 1),
  agg AS (SELECT id_cliente, count(*) AS qtd_registros, CAST(max(CASE WHEN source_type = 'file' THEN 1 ELSE 0 END) AS INTEGER) AS tem_file,
    CAST(max(CASE WHEN source_type = 'table' THEN 1 ELSE 0 END) AS INTEGER) AS tem_table, coalesce(max(status) FILTER (status = 'ATIVO'), min(status)) AS status_final FROM records GROUP BY 1),
  consolidated AS (SELECT * FROM seg JOIN src USING (id_cliente) JOIN agg USING (id_cliente))"""
LABELLED_SQL = """labelled AS (SELECT *, CASE status_final WHEN 'ATIVO' THEN 1.0::DOUBLE WHEN 'INATIVO' THEN 0.0 END AS label FROM consolidated WHERE status_final IN ('ATIVO', 'INATIVO'))"""


def records(t: Tables) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    active = (F.col("o_orderstatus") == "O") & (cust % 3 > 0)
    return t.orders.select(
        cust.alias("id_cliente"),
        F.col("o_orderpriority").alias("segmento"),
        F.when(key % 3 == 0, "table").when(key % 3 == 1, "file").otherwise("api").alias("source_type"),
        F.when(active, "ATIVO").when(cust % 11 == 5, "SUSPENSO").otherwise("INATIVO").alias("status"),
        F.col("o_orderdate").alias("ts"),
        key.alias("record_id"),
    )


@query("f1_consolidate", f"WITH {RECORDS_SQL}, {CONSOLIDATED_SQL} SELECT * FROM consolidated")
def f1(t: Tables) -> DataFrame:
    return datasets.consolidate(records(t))


@query("f2_survivorship", f"""WITH {RECORDS_SQL} SELECT id_cliente, source_type, record_id, status FROM records QUALIFY row_number() OVER (PARTITION BY id_cliente
  ORDER BY CASE source_type WHEN 'table' THEN 1 WHEN 'file' THEN 2 ELSE 3 END, ts DESC, record_id DESC) = 1""")  # fmt: skip
def f2(t: Tables) -> DataFrame:
    rows = datasets.survivorship(records(t), newest("ts", "record_id"))
    return rows.select("id_cliente", "source_type", "record_id", "status")


@query("f3_gold_actives", f"WITH {RECORDS_SQL}, {CONSOLIDATED_SQL} SELECT id_cliente, segmento_dominante, qtd_registros FROM consolidated WHERE status_final = 'ATIVO'")
def f3(t: Tables) -> DataFrame:
    columns = ["id_cliente", "segmento_dominante", "qtd_registros"]
    return clean.active_customers(datasets.consolidate(records(t)), columns, "status_final")


@query("f4_label_mapping", f"WITH {RECORDS_SQL}, {CONSOLIDATED_SQL}, {LABELLED_SQL} SELECT id_cliente, label FROM labelled")
def f4(t: Tables) -> DataFrame:
    return datasets.with_label(datasets.consolidate(records(t))).select("id_cliente", "label")


@query("f5_dataset_split", f"WITH {RECORDS_SQL}, {CONSOLIDATED_SQL}, {LABELLED_SQL} SELECT id_cliente, label, CASE WHEN id_cliente % 3 = 0 THEN 'test' ELSE 'train' END AS dataset_split FROM labelled")
def f5(t: Tables) -> DataFrame:
    return training_set(t).select("id_cliente", "label", "dataset_split")


def training_set(t: Tables) -> DataFrame:
    return datasets.with_split(datasets.with_label(datasets.consolidate(records(t))))


# An unregularised fit with an intercept reproduces the mean label of every one-hot category of its rows.
@query("f6_category_means", f"""WITH {RECORDS_SQL}, {CONSOLIDATED_SQL}, {LABELLED_SQL} SELECT segmento_dominante, count(*) AS row_count, round(avg(label), 3) AS mean_score
  FROM labelled WHERE id_cliente % 3 > 0 GROUP BY 1""")  # fmt: skip
def f6_means(t: Tables) -> DataFrame:
    train = training_set(t).filter("dataset_split = 'train'")
    scored = datasets.score_rows(datasets.train_classifier(train), train, ["segmento_dominante"])
    return scored.groupBy("segmento_dominante").agg(F.count(F.lit(1)).alias("row_count"), F.round(F.avg("score"), 3).alias("mean_score"))


@query("f7_scored_counts", f"""WITH {RECORDS_SQL}, {CONSOLIDATED_SQL}, {LABELLED_SQL} SELECT CASE WHEN id_cliente % 3 = 0 THEN 'test' ELSE 'train' END AS dataset_split, segmento_dominante,
  count(*) AS row_count, count(*) AS agreeing FROM labelled GROUP BY 1, 2""")  # fmt: skip
def f7_counts(t: Tables) -> DataFrame:
    """Every row is scored, and its prediction follows from its score."""
    scored = f7(t)
    agreeing = F.count(F.when(F.col("prediction") == F.when(F.col("score") > 0.5, 1.0).otherwise(0.0), 1))
    return scored.groupBy("dataset_split", "segmento_dominante").agg(F.count(F.lit(1)).alias("row_count"), agreeing.alias("agreeing"))


# The other fitted numbers have no SQL form; tests compare them with the evaluator of the ML library.
@query("f6_train_classifier")
def f6(t: Tables) -> DataFrame:
    rows = training_set(t)
    scored = datasets.score_rows(datasets.train_classifier(rows), rows, ["dataset_split", "label"])
    hit = F.when(F.col("label") == F.col("prediction"), 1.0).otherwise(0.0)
    return scored.groupBy("dataset_split").agg(F.count(F.lit(1)).alias("row_count"), F.avg(hit).alias("accuracy"))


@query("f7_batch_scoring")
def f7(t: Tables) -> DataFrame:
    rows = training_set(t)
    model = datasets.train_classifier(rows)
    keep = ["id_cliente", "segmento_dominante", "source_type_dominante", "label", "dataset_split"]
    return datasets.score_rows(model, rows, keep)


@query("f8_train_and_score", f"""WITH {RECORDS_SQL}, {CONSOLIDATED_SQL}, {LABELLED_SQL}, tables AS (
  SELECT 'training' AS table_name, CASE WHEN id_cliente % 3 = 0 THEN 'test' ELSE 'train' END AS part, count(*) AS row_count FROM labelled GROUP BY 2
  UNION ALL SELECT 'predictions', CASE WHEN id_cliente % 3 = 0 THEN 'test' ELSE 'train' END, count(*) FROM consolidated GROUP BY 2
  UNION ALL SELECT 'metrics', m, 1 FROM (VALUES ('accuracy'), ('f1'), ('precision'), ('recall'), ('auc')) v(m)
  UNION ALL SELECT 'confusion', 'test', count(*) FROM labelled WHERE id_cliente % 3 = 0
  UNION ALL SELECT 'smoke', s, 1 FROM (VALUES ('STARTED'), ('SUCCESS')) v(s)) SELECT * FROM tables""")  # fmt: skip
def f8(t: Tables) -> DataFrame:
    """Rows per stored table of a whole run; the fitted predictions themselves have no SQL form."""
    schema, base = scratch_schema(t.spark), scratch_folder(t.spark)
    run = f"r{uuid.uuid4().hex[:8]}"
    train_and_score(t.spark, records(t), schema, "clf", run, run, ts("2024-02-01"), "dev", "demo", base_path=f"{base}/models")

    def counted(table: str, name: str, part: str, count: str = "count(1)", logged: bool = True) -> DataFrame:
        rows = t.spark.table(f"{schema}.{table}")
        rows = rows.filter(F.col("run_id") == run) if logged else rows
        return rows.groupBy(F.expr(part).alias("part")).agg(F.expr(count).alias("row_count")).select(
            F.lit(name).alias("table_name"), "part", "row_count"
        )

    return union_all(
        [
            counted("tb_clientes_training_dataset_v2", "training", "dataset_split", logged=False),
            counted("tb_model_predictions", "predictions", "dataset_split"),
            counted("tb_model_evaluation", "metrics", "metric_name"),
            counted("tb_model_confusion_matrix", "confusion", "'test'", "sum(record_count)"),
            counted("tb_ml_smoke_runs", "smoke", "status"),
        ]
    )
