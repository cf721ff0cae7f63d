"""The Spark session that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "causeway", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings by name, with ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
