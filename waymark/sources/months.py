"""Event tables by month: written once in folders, read only where a month is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_months(rows: DataFrame, path: str, month: str = "month") -> None:
    """One folder for each month; months that rows holds replace those that were there."""
    rows.write.mode("overwrite").partitionBy(month).option("partitionOverwriteMode", "dynamic").parquet(path)


def read_months(spark: SparkSession, path: str, schema: str, wanted: DataFrame | None = None, month: str = "month") -> DataFrame:
    """The rows of the months that wanted(month) names, all without it. Folders of other months are not opened: the
    names are a small table, so Spark prunes the scan with them while the query runs."""
    rows = spark.read.schema(schema).parquet(path).withColumn(month, F.col(month).cast("string"))
    if wanted is None:
        return rows
    names = wanted.select(F.col(month).cast("string").alias(month)).where(F.col(month).rlike("^[0-9]{6}$")).distinct()
    return rows.join(F.broadcast(names), month, "left_semi")  # at most 12 rows a year
