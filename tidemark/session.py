"""A Spark session with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tidemark", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """Get or create a session with the settings above and those of ``conf``."""
    builder = SparkSession.builder.appName(name).config(map=CONF | (conf or {}))
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()
