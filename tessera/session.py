"""The session the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with ``SETTINGS``; the number of shuffle partitions and memory stay the cluster's own."""
    builder = SparkSession.builder.appName("tessera").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
