"""A Spark session with the settings that the package is made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "loomline", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.speculation": "false",  # sinks would be written twice at the same time
    }
    return builder.config(map=defaults | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()
