"""Session settings the library is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# AQE re-plans joins from measured sizes and splits skewed join partitions; the
# join-backs in this library are written so that it may (left side is the rows,
# right side has one row per key).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Methods beyond 8000 bytes of code are interpreted by the JVM; better fall back earlier.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "priorform", **conf: str) -> SparkSession:
    """Get or create a session; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def local_session(cpus: int | None = None, app: str = "priorform", **conf: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    cpus = cpus or os.cpu_count() or 1
    settings = {
        "spark__master": f"local[{cpus}]",
        "spark__sql__shuffle__partitions": str(cpus),
        "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false",
        "spark__driver__memory": "12g",
        **conf,
    }
    return build_session(app, **settings)
