"""Spark session settings shared by tests, bench and scripts."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "waymark", master: str = "local[8]", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the engine relies on (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
