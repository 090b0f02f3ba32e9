"""Session settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, partitions: int | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("tidemark")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}) | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
