"""A session with the settings that the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "groundspark", **more: str) -> SparkSession:
    """Adaptive execution and its skew handling stay on; the rest is the cluster's to set."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in more.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
