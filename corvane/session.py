"""The session builder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "corvane", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and skew handling. Master and sizes come from the cluster's own settings."""
    builder = SparkSession.builder.appName(name)
    for k, v in {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", **conf,
    }.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def local(cpus: int | None = None) -> SparkSession:
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return session(**{"spark.master": f"local[{n}]", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": str(n), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
