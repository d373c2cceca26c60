"""The session that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "vellumflow", **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic, adaptive execution; further settings by name with __ for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
