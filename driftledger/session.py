"""Session factory with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Time zone for comparable timestamps; adaptive execution for skew and for small shuffles.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def get_session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("driftledger").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
