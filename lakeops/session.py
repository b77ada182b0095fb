"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Plan-shaping settings the operators rely on; cluster sizing stays with the submitter.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture costs several driver round trips per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "lakeops", master: str | None = None, **conf: str) -> SparkSession:
    """Create or fetch a session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; ``fallback`` only where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if fallback:
        return fallback
    raise ValueError("spark.checkpoint.dir is not set and no fallback folder was given")
