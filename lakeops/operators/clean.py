"""Layer cleaning: standardised silver tables and gold projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.sources.tables import stamp

GOLD_COLUMNS = ("id_cliente", "nome", "segmento", "status", "dt_ingestao", "dt_processamento")


def standardize_customers(df: DataFrame, as_of=None) -> DataFrame:
    """Trimmed name, upper-case segment and status, processing time."""
    cleaned = df.withColumns({"nome": F.trim("nome"), "segmento": F.upper("segmento"), "status": F.upper("status")})
    return stamp(cleaned, as_of, ("dt_processamento",))


def standardize_contacts(df: DataFrame, as_of=None) -> DataFrame:
    """Renamed key, trimmed name, lower-case e-mail, digits-only phone, load times."""
    cleaned = df.select(
        F.col("id_cliente_origem").alias("id_cliente"),
        F.trim("nm_cliente").alias("nm_cliente"),
        F.lower(F.trim("ds_email")).alias("ds_email"),
        F.regexp_replace("nr_telefone", "[^0-9]", "").alias("nr_telefone"),
        "dt_referencia",
    )
    return stamp(cleaned, as_of)


def active_customers(df: DataFrame, columns: Sequence[str] = GOLD_COLUMNS, status: str = "status") -> DataFrame:
    """Rows with status ``ATIVO``, fixed projection."""
    return df.filter(F.col(status) == "ATIVO").select(*columns)


def time_window(df: DataFrame, timestamp: str, start=None, end=None) -> DataFrame:
    """Half-open window [start, end); an empty bound is skipped. The column stays bare so that the
    filter reaches the scan."""

    def bound(value) -> Column:
        literal = F.lit(value)
        return literal.cast(df.schema[timestamp].dataType) if isinstance(value, str) else literal

    result = df
    if start:
        result = result.filter(F.col(timestamp) >= bound(start))
    if end:
        result = result.filter(F.col(timestamp) < bound(end))
    return result


def numeric_pair(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Prediction and label as doubles; unreadable text is an error."""
    return df.withColumns({"prediction": F.col(prediction).cast("double"), "label": F.col(label).cast("double")})
