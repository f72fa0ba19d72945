"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "mnemospark", **settings: str) -> SparkSession:
    """Cluster settings win: only what changes results, or what Spark leaves off, is set here."""
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=fixed | settings).getOrCreate()
