"""Table specifications, classification and masking."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.checks.base import Tables, query, scratch_folder
from lakeops.operators import governance as gov
from lakeops.sources.buckets import read_buckets

# One specification per part, its columns from the line items of the part.
TABLES_SQL = """tables AS (SELECT p_partkey AS spec_id, CASE WHEN p_size % 9 = 0 THEN ' ' WHEN p_size % 2 = 0 THEN 'main' END AS catalog_name,
  CASE WHEN p_size = 7 THEN '' ELSE lower(p_type) END AS schema_name, CASE WHEN p_size = 8 THEN '  ' ELSE p_name END AS table_name,
  CASE WHEN p_size = 9 THEN NULL ELSE p_name END AS table_description, p_size % 3 <> 0 AS has_all, p_size % 4 <> 0 AS has_tag,
  CASE WHEN p_size % 4 = 1 THEN p_brand ELSE p_name END AS tag, CASE WHEN p_size % 6 = 0 THEN 'parquet' WHEN p_size % 6 <> 1 THEN 'delta' END AS using_format FROM part)"""
COLUMNS_SQL = """columns AS (SELECT l_partkey AS spec_id, CASE WHEN l_quantity > 48 THEN '' ELSE CASE WHEN l_returnflag = 'A' THEN 'C' ELSE 'c' END || l_linenumber END AS name,
  CASE WHEN l_quantity = 1 THEN ' ' ELSE 'STRING' END AS data_type, CASE WHEN l_quantity > 2 THEN l_linestatus END AS comment FROM lineitem)"""
TAGS_SQL = """tags AS (SELECT DISTINCT l_partkey AS spec_id, 'C' || (l_linenumber + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 2 END) AS column_name, l_linestatus = 'F' AS has_pii, l_linenumber % 2 = 0 AS has_class FROM lineitem)"""


def tables(t: Tables) -> DataFrame:
    size = F.col("p_size")
    full = F.create_map(*[F.lit(x) for p in gov.DEFAULT_PROPERTIES.items() for x in p])
    short = F.create_map(F.lit("delta.minReaderVersion"), F.lit("3"))
    tag = F.create_map(F.lit(gov.DESCRIPTION_TAG), F.when(size % 4 == 1, F.col("p_brand")).otherwise(F.col("p_name")))
    return t.part.select(
        F.col("p_partkey").alias("spec_id"),
        F.when(size % 9 == 0, " ").when(size % 2 == 0, "main").alias("catalog_name"),
        F.when(size == 7, "").otherwise(F.lower("p_type")).alias("schema_name"),
        F.when(size == 8, "  ").otherwise(F.col("p_name")).alias("table_name"),
        F.when(size != 9, F.col("p_name")).alias("table_description"),
        F.when(size % 3 != 0, full).otherwise(short).alias("table_properties"),
        F.when(size % 4 != 0, tag).otherwise(F.create_map().cast("map<string,string>")).alias("table_tags"),
        F.when(size % 6 == 0, "parquet").when(size % 6 != 1, "delta").alias("using_format"),
    )


def columns(t: Tables) -> DataFrame:
    quantity = F.col("l_quantity")
    prefix = F.when(F.col("l_returnflag") == "A", "C").otherwise("c")
    return t.lineitem.select(
        F.col("l_partkey").alias("spec_id"),
        F.when(quantity > 48, "").otherwise(F.concat(prefix, "l_linenumber")).alias("name"),
        F.when(quantity == 1, " ").otherwise("STRING").alias("data_type"),
        F.when(quantity > 2, F.col("l_linestatus")).alias("comment"),
    )


def column_tags(t: Tables) -> DataFrame:
    pii, graded = F.col("l_linestatus") == "F", F.col("l_linenumber") % 2 == 0
    rows = t.lineitem.select(
        F.col("l_partkey").alias("spec_id"),
        F.concat(F.lit("C"), F.col("l_linenumber") + F.when(pii, 0).otherwise(2)).alias("column_name"),
        pii.alias("has_pii"),
        graded.alias("has_class"),
    ).distinct()
    none = F.create_map().cast("map<string,string>")
    tags = F.map_concat(
        F.when(F.col("has_pii"), F.create_map(F.lit("pii"), F.lit("sim"))).otherwise(none),
        F.when(F.col("has_class"), F.create_map(F.lit("classificacao"), F.lit("interno"), F.lit("mascaramento"), F.lit("mascarado"))).otherwise(none),
    )
    return rows.select("spec_id", "column_name", tags.alias("tags"))


COLUMN_RULES_SQL = """SELECT spec_id, 'blank_column_name' AS rule, '' AS detail FROM columns WHERE trim(name) = '' UNION ALL SELECT spec_id, 'blank_column_type', name FROM columns WHERE trim(data_type) = ''
  UNION ALL SELECT spec_id, 'blank_column_comment', name FROM columns WHERE comment IS NULL OR trim(comment) = ''
  UNION ALL SELECT spec_id, 'no_columns', '' FROM tables ANTI JOIN columns USING (spec_id)"""
TAG_MISSING_SQL = "concat_ws(',', CASE WHEN NOT has_class THEN 'classificacao' END, CASE WHEN NOT has_pii THEN 'pii' END)"


@query("g1_spec_audit", f"""WITH {TABLES_SQL}, {COLUMNS_SQL}, {TAGS_SQL}, names AS (SELECT spec_id, lower(name) AS column_name, count(*) AS n FROM columns GROUP BY 1, 2),
  low AS (SELECT spec_id, lower(column_name) AS column_name, has_pii, has_class FROM tags)
  SELECT spec_id, 'blank_catalog' AS rule, '' AS detail FROM tables WHERE trim(catalog_name) = '' UNION ALL SELECT spec_id, 'blank_schema', '' FROM tables WHERE trim(schema_name) = ''
  UNION ALL SELECT spec_id, 'blank_table', '' FROM tables WHERE trim(table_name) = '' UNION ALL SELECT spec_id, 'blank_description', '' FROM tables WHERE coalesce(trim(table_description), '') = ''
  UNION ALL SELECT spec_id, 'missing_properties', 'delta.enableDeletionVectors,delta.minWriterVersion' FROM tables WHERE NOT has_all
  UNION ALL SELECT spec_id, 'missing_description_tag', '' FROM tables WHERE NOT has_tag UNION ALL SELECT spec_id, 'description_differs', '' FROM tables WHERE has_tag AND tag IS DISTINCT FROM table_description
  UNION ALL {COLUMN_RULES_SQL} UNION ALL SELECT spec_id, 'duplicate_column', column_name FROM names WHERE n > 1
  UNION ALL SELECT spec_id, 'column_without_tags', column_name FROM names ANTI JOIN low USING (spec_id, column_name)
  UNION ALL SELECT DISTINCT spec_id, 'tags_of_unknown_column', column_name FROM low ANTI JOIN names USING (spec_id, column_name)
  UNION ALL SELECT spec_id, 'missing_column_tags', column_name || ':' || {TAG_MISSING_SQL} FROM low WHERE NOT (has_pii AND has_class)""")  # fmt: skip
def g1(t: Tables) -> DataFrame:
    return gov.audit_specs(tables(t), columns(t), column_tags(t))


@query("g2_contract_audit", f"""WITH {TABLES_SQL}, {COLUMNS_SQL} SELECT spec_id, 'format_not_delta' AS rule, '' AS detail FROM tables WHERE using_format IS DISTINCT FROM 'delta'
  UNION ALL SELECT spec_id, 'blank_description', '' FROM tables WHERE coalesce(trim(table_description), '') = '' UNION ALL {COLUMN_RULES_SQL}
  UNION ALL SELECT spec_id, 'missing_property', 'owner.team' FROM tables""")  # fmt: skip
def g2(t: Tables) -> DataFrame:
    return gov.audit_contracts(tables(t), columns(t), mandatory=[*gov.DEFAULT_PROPERTIES, "owner.team"])


@query("g3_classification", f"""WITH {COLUMNS_SQL}, {TAGS_SQL}, names AS (SELECT spec_id, lower(name) AS column_name FROM columns), low AS (SELECT spec_id, lower(column_name) AS column_name, has_pii, has_class FROM tags)
  SELECT spec_id, count(*) AS column_count, count(*) FILTER (has_class) AS classified_count, count(*) FILTER (has_pii) AS pii_count, count(*) FILTER (has_class) AS masked_count
  FROM names LEFT JOIN low USING (spec_id, column_name) GROUP BY 1""")  # fmt: skip
def g3(t: Tables) -> DataFrame:
    return gov.classification_summary(columns(t), column_tags(t))


MASK_TAGS = {"c_name": {"mascaramento": "mascarado"}, "email": {"mascaramento": "mascarado"}, "phone": {"mascaramento": "mascarado"}, "c_mktsegment": {"mascaramento": "aberto"}}


@query("g4_mask_columns", """SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS c_name,
  '***@mail.com' AS email, regexp_replace('11-' || c_custkey, '[0-9]', '*', 'g') AS phone, c_mktsegment FROM customer""")  # fmt: skip
def g4(t: Tables) -> DataFrame:
    rows = t.customer.select(
        "c_custkey", "c_name", F.concat("c_name", F.lit("@mail.com")).alias("email"), F.concat(F.lit("11-"), "c_custkey").alias("phone"), "c_mktsegment"
    )
    return gov.mask_columns(rows, MASK_TAGS, ["owners"], ["guests"], {"email": "email", "phone": "digits"})


CONTROL_SQL = """control AS (SELECT CAST(n_nationkey AS BIGINT) AS nation, n_nationkey % 2 = 0 AS anonimizar, n_nationkey % 3 > 0 AS pass_masking, n_nationkey % 5 = 0 AS granted FROM nation)"""


@query("g4_mask_by_control", f"""WITH {CONTROL_SQL} SELECT c_custkey, CASE WHEN anonimizar AND pass_masking AND NOT granted THEN sha256(c_name) ELSE c_name END AS c_name
  FROM customer LEFT JOIN control ON nation = c_nationkey""")  # fmt: skip
def g4_control(t: Tables) -> DataFrame:
    nation = F.col("n_nationkey")
    control = t.nation.select(
        nation.alias("c_nationkey"),
        (nation % 2 == 0).alias("anonimizar"),
        (nation % 3 > 0).alias("pass_masking"),
        F.when(nation % 5 == 0, F.array(F.lit("guests"))).otherwise(F.array(F.lit("owners"))).alias("grant_view_dados"),
    )
    rows = t.customer.select("c_custkey", "c_nationkey", "c_name")
    return gov.mask_by_control(rows, control, ["c_nationkey"], ["c_name"], ["guests"], "hash").drop("c_nationkey")


STORED_CONTROL_SQL = """WITH control AS (SELECT DISTINCT 'main' AS catalog, 'brz' AS schema, 't' || o_custkey AS tabela, o_orderpriority AS coluna FROM orders),
  fresh AS (SELECT DISTINCT 'main' AS catalog, 'brz' AS schema, 't' || (l_suppkey * 11) AS tabela, CASE WHEN l_returnflag = 'A' THEN '1-URGENT' ELSE l_returnflag END AS coluna FROM lineitem)
  SELECT coalesce(c.tabela, f.tabela) AS tabela, coalesce(c.coluna, f.coluna) AS coluna, f.tabela IS NOT NULL AS anonimizar, f.tabela IS NOT NULL AS pass_masking,
  CASE WHEN f.tabela IS NOT NULL THEN 'GRUPO' ELSE 'old' END AS grants, CASE WHEN f.tabela IS NOT NULL THEN 'SELECT' ELSE 'NONE' END AS tipo_de_acesso
  FROM control c FULL JOIN fresh f USING (tabela, coluna)"""  # fmt: skip


def control_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = F.array(F.lit("old"))
    control = t.orders.select(
        F.lit("main").alias("catalog"),
        F.lit("brz").alias("schema"),
        F.concat(F.lit("t"), "o_custkey").alias("tabela"),
        F.col("o_orderpriority").alias("coluna"),
    ).distinct()
    control = control.withColumns(
        {
            "anonimizar": F.lit(False),
            "pass_masking": F.lit(False),
            "grant_view_dados": old,
            "acesso_a_tabela": old,
            "tipo_de_acesso": F.lit("NONE"),
            "owner": old,
        }
    )
    fresh = t.lineitem.select(
        F.lit("main").alias("catalog"),
        F.lit("brz").alias("schema"),
        F.concat(F.lit("t"), F.col("l_suppkey") * 11).alias("tabela"),
        F.when(F.col("l_returnflag") == "A", "1-URGENT").otherwise(F.col("l_returnflag")).alias("coluna"),
    ).distinct()
    return control, gov.control_rows(fresh, ["GRUPO"], ["DONO"])


def control_report(rows: DataFrame) -> DataFrame:
    return rows.select(
        "tabela", "coluna", "anonimizar", "pass_masking", F.array_join("grant_view_dados", ";").alias("grants"), "tipo_de_acesso"
    )


@query("g5_masking_control", STORED_CONTROL_SQL)
def g5(t: Tables) -> DataFrame:
    return control_report(gov.upsert_control(*control_sides(t)))


@query("g5_upsert_table", STORED_CONTROL_SQL)
def g5_table(t: Tables) -> DataFrame:
    """The stored control table: the fresh rows are merged twice, the second time without effect."""
    control, fresh = control_sides(t)
    path = f"{scratch_folder(t.spark)}/control-{uuid.uuid4().hex}"
    gov.store_control(control, path, 8)
    for _ in range(2):
        gov.store_control(fresh, path)
    return control_report(read_buckets(t.spark, path))
