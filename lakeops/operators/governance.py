"""Table specifications as data: audits, classification, masking and its control table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.functions.rules import blank
from lakeops.functions.text import masked_text
from lakeops.operators.events import null_safe, upsert
from lakeops.operators.profile import union_all
from lakeops.sources.buckets import create_buckets, upsert_buckets

# Required properties and tags.
REQUIRED_PROPERTIES = ("delta.enableDeletionVectors", "delta.minReaderVersion", "delta.minWriterVersion")
DEFAULT_PROPERTIES = {
    "delta.enableDeletionVectors": "true",
    "delta.feature.appendOnly": "supported",
    "delta.feature.deletionVectors": "supported",
    "delta.feature.invariants": "supported",
    "delta.minReaderVersion": "3",
    "delta.minWriterVersion": "7",
}
DESCRIPTION_TAG = "descricao_tabela"
REQUIRED_COLUMN_TAGS = ("pii", "classificacao")
CONTROL_KEY = ("catalog", "schema", "tabela", "coluna")


def _words(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _entry(rule: str, detail: Column | None = None) -> Column:
    return F.struct(F.lit(rule).alias("rule"), (F.lit("") if detail is None else detail).alias("detail"))


def _entries(df: DataFrame, key: str, entries: Sequence[Column]) -> DataFrame:
    """(key, rule, detail) rows of the entries that are not NULL. They are dropped after the explode: a lambda over the array
    would be interpreted for every row, with all conditions in it."""
    rows = df.select(key, F.explode(F.array(*entries)).alias("v"))
    return rows.filter(F.col("v").isNotNull()).select(key, "v.rule", "v.detail")


def _violations(df: DataFrame, key: str, checks: Sequence[tuple[str, Column, Column | None]]) -> DataFrame:
    """(key, rule, detail) rows of all checks (rule, condition, detail) in one pass over ``df``."""
    return _entries(df, key, [F.when(F.coalesce(condition, F.lit(False)), _entry(rule, detail)) for rule, condition, detail in checks])


def _counts(keys: Sequence[str], **parts: DataFrame) -> DataFrame:
    """Rows per key of each part, as a column named like it; parts without the key count 0."""
    rows = [df.select(*keys, *[F.lit(int(n == name)).alias(n) for n in parts]) for name, df in parts.items()]
    return union_all(rows).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in parts])


def _column_checks() -> list[tuple[str, Column, Column | None]]:
    return [
        ("blank_column_name", blank("name"), None),
        ("blank_column_type", blank("data_type"), F.col("name")),
        ("blank_column_comment", blank("comment"), F.col("name")),
    ]


def audit_specs(tables: DataFrame, columns: DataFrame, column_tags: DataFrame, key: str = "spec_id") -> DataFrame:
    """Violations (spec, rule, detail) of table specifications.

    ``tables``: key, catalog_name, schema_name, table_name, table_description, table_properties MAP,
    table_tags MAP. ``columns``: key, name, data_type, comment. ``column_tags``: key, column_name,
    tags MAP. Rules: blank names, descriptions, types and comments, no columns, repeated columns
    (ignoring case), missing required properties, missing or different description tag, columns
    without tags, tags of unknown columns, missing required column tags.
    """
    missing = F.array_except(_words(REQUIRED_PROPERTIES), F.map_keys(F.coalesce("table_properties", F.create_map())))
    tag = F.element_at(F.col("table_tags"), DESCRIPTION_TAG)
    has_tag = F.coalesce(F.map_contains_key("table_tags", DESCRIPTION_TAG), F.lit(False))
    no_tags = F.array_except(_words(REQUIRED_COLUMN_TAGS), F.map_keys(F.coalesce("tags", F.create_map())))
    lower_tag = F.lower("column_name")
    table_checks = [
        ("blank_catalog", F.col("catalog_name").isNotNull() & blank("catalog_name"), None),
        ("blank_schema", blank("schema_name"), None),
        ("blank_table", blank("table_name"), None),
        ("blank_description", blank("table_description"), None),
        ("missing_properties", F.size(missing) > 0, F.array_join(F.array_sort(missing), ",")),
        ("missing_description_tag", ~has_tag, None),
        ("description_differs", has_tag & ~tag.eqNullSafe(F.col("table_description")), None),
    ]
    tag_checks = [
        ("missing_column_tags", F.size(no_tags) > 0, F.concat_ws(":", lower_tag, F.array_join(F.array_sort(no_tags), ",")))
    ]
    # What a row violates by itself needs no shuffle. Only counts per (lower-case) column name and per specification do.
    names = _counts(
        [key, "column_name"],
        columns=columns.select(key, F.lower("name").alias("column_name")),
        tags=column_tags.select(key, lower_tag.alias("column_name")),
    )
    name = F.col("column_name")
    name_checks = [
        ("duplicate_column", F.col("columns") > 1, name),
        ("column_without_tags", (F.col("columns") > 0) & (F.col("tags") == 0), name),
        ("tags_of_unknown_column", F.col("columns") == 0, name),
    ]
    empty = _counts([key], specs=tables, columns=columns).filter(F.col("columns") == 0)
    return union_all(
        [
            _violations(tables, key, table_checks),
            _violations(columns, key, _column_checks()),
            _violations(column_tags, key, tag_checks),
            _violations(names, key, name_checks),
            empty.select(key, F.lit("no_columns").alias("rule"), F.explode(F.array_repeat(F.lit(""), F.col("specs").cast("int"))).alias("detail")),
        ]
    )


def audit_contracts(
    tables: DataFrame,
    columns: DataFrame,
    key: str = "spec_id",
    defaults: Mapping[str, str] = DEFAULT_PROPERTIES,
    mandatory: Sequence[str] = tuple(DEFAULT_PROPERTIES),
) -> DataFrame:
    """Contract violations: format, description, columns, column fields and mandatory properties
    after the defaults are merged in (own properties win)."""
    own = F.coalesce("table_properties", F.create_map().cast("map<string,string>"))
    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair]) if defaults else own
    keys = F.array_union(F.map_keys(base), F.map_keys(own))
    missing = F.array_except(_words(mandatory), keys)
    with_columns = columns.select(key).distinct()
    empty = tables.join(with_columns, null_safe(tables, with_columns, (key,)), "left_anti")
    return union_all(
        [
            _violations(
                tables,
                key,
                [
                    ("format_not_delta", ~F.coalesce(F.col("using_format") == "delta", F.lit(False)), None),
                    ("blank_description", blank("table_description"), None),
                ],
            ),
            _violations(empty, key, [("no_columns", F.lit(True), None)]),
            _violations(columns, key, _column_checks()),
            tables.select(key, F.lit("missing_property").alias("rule"), F.explode(missing).alias("detail")),
        ]
    )


def classification_summary(columns: DataFrame, column_tags: DataFrame, key: str = "spec_id") -> DataFrame:
    """Per table: columns, classified columns, personal-data columns and masked columns."""
    names = columns.select(key, F.lower("name").alias("column_name"))
    tags = column_tags.select(key, F.lower("column_name").alias("column_name"), "tags")
    joined = names.join(tags, [key, "column_name"], "left")

    def count_if(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    return joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("column_count"),
        count_if(F.map_contains_key("tags", "classificacao")).alias("classified_count"),
        count_if(F.element_at("tags", "pii") == "sim").alias("pii_count"),
        count_if(F.element_at("tags", "mascaramento") == "mascarado").alias("masked_count"),
    )


def is_granted(groups: Sequence[str], caller_groups: Sequence[str]) -> bool:
    return bool(set(groups) & set(caller_groups))


def mask_columns(
    df: DataFrame,
    column_tags: Mapping[str, Mapping[str, str]],
    granted_groups: Sequence[str] = (),
    caller_groups: Sequence[str] = (),
    styles: Mapping[str, str] | None = None,
    default_style: str = "full",
) -> DataFrame:
    """Mask the columns tagged ``mascarado`` unless the caller is in a granted group."""
    if is_granted(granted_groups, caller_groups):
        return df
    styles = styles or {}
    masked = {name for name, tags in column_tags.items() if tags.get("mascaramento") == "mascarado"}
    return df.select(
        *[
            masked_text(F.col(c).cast("string"), styles.get(c, default_style)).alias(c) if c in masked else F.col(c)
            for c in df.columns
        ]
    )


def mask_by_control(
    df: DataFrame,
    control: DataFrame,
    row_columns: Sequence[str],
    values: Sequence[str],
    caller_groups: Sequence[str],
    style: str = "full",
) -> DataFrame:
    """Mask values of rows whose control row (joined on ``row_columns``) asks for it and grants none
    of the caller's groups. The masking decision is data, so one call serves many tables.

    Closed by default: missing grants grant nobody, missing flags ask for masking, and of repeated control
    rows one that masks is enough. Rows without a control row stay open.
    """
    callers = F.array(*[F.lit(g) for g in caller_groups]) if caller_groups else F.array().cast("array<string>")
    asked = F.coalesce("anonimizar", F.lit(True)) & F.coalesce("pass_masking", F.lit(True))
    granted = F.coalesce(F.arrays_overlap("grant_view_dados", callers), F.lit(False))
    rule = control.groupBy(*row_columns).agg(F.bool_or(asked & ~granted).alias("__mask"))
    joined = df.join(rule, list(row_columns), "left")
    hide = F.coalesce("__mask", F.lit(False))
    return joined.select(
        *[
            F.when(hide, masked_text(F.col(c).cast("string"), style)).otherwise(F.col(c).cast("string")).alias(c)
            if c in values
            else F.col(c)
            for c in df.columns
        ]
    )


def control_rows(columns: DataFrame, groups: Sequence[str], owners: Sequence[str]) -> DataFrame:
    """Control rows that mask the given (catalog, schema, tabela, coluna) columns."""
    return columns.select(
        *CONTROL_KEY,
        F.lit(True).alias("anonimizar"),
        F.lit(True).alias("pass_masking"),
        _words(groups).alias("grant_view_dados"),
        _words(groups).alias("acesso_a_tabela"),
        F.lit("SELECT").alias("tipo_de_acesso"),
        _words(owners).alias("owner"),
    )


def upsert_control(control: DataFrame, rows: DataFrame) -> DataFrame:
    """Control table after merging masking rows on its four-column key."""
    return upsert(control, rows, CONTROL_KEY)


def store_control(rows: DataFrame, path: str, buckets: int | None = None) -> None:
    """Merge masking rows into the control table stored at ``path`` in key buckets; with ``buckets`` the table is made
    anew from them."""
    if buckets is not None:
        create_buckets(rows, path, CONTROL_KEY, buckets)
    else:
        upsert_buckets(rows, path)
