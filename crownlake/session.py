"""Session factory with the settings that the engine's expressions are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "crownlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with CONF; master and further settings are left to spark-submit unless given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (CONF | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
