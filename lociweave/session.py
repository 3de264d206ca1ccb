"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "lociweave", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; `conf` overrides with _ for dots."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=base | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
