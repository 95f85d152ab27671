"""A session with the settings this library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "lodestack", **more: str) -> SparkSession:
    """On a cluster, set the number of shuffle partitions so that one holds some 100 to 200 MB."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()
