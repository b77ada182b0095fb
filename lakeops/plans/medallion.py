"""Bronze, silver and gold tables of a customer feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeops.operators.clean import active_customers, standardize_customers
from lakeops.sources.tables import overwrite_table, stamp

BRONZE, SILVER, GOLD = "raw_clientes", "tb_clientes", "tb_clientes_ativos"


def run_layers(spark: SparkSession, feed: DataFrame, schema: str, as_of=None, stamped: bool = False) -> DataFrame:
    """Write the three layers, each read back from the table before it; returns the gold table.

    ``stamped`` feeds already carry their ingestion time.
    """
    bronze, silver, gold = (f"{schema}.{name}" for name in (BRONZE, SILVER, GOLD))
    overwrite_table(feed if stamped else stamp(feed, as_of, ("dt_ingestao",)), bronze)
    overwrite_table(standardize_customers(spark.table(bronze), as_of), silver)
    overwrite_table(active_customers(spark.table(silver)), gold)
    return spark.table(gold)
