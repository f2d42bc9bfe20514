"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tracemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI rules and adaptive execution; on a cluster, sizes are left to its own settings."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
