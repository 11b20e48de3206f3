"""The session that queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI, adaptive execution with skew handling; partitions only where a cluster's default won't do."""
    b = SparkSession.builder.appName("sparkloom")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
