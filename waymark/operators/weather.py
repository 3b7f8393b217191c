"""Hourly weather: re-grid with forward fill, the value at a snapshot, the blend of two stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .clean import keep_last

#: The variables of the weather tables.
VARIABLES = ("temperature_2m", "rain", "snowfall", "relative_humidity_2m", "wind_speed_10m")


def hourly(rows: DataFrame, variables=VARIABLES, by: str = "seq") -> DataFrame:
    """rows(op_id, time, ..): one row an hour between a station's first and last, gaps filled forward, last duplicate kept."""
    once = keep_last(rows, ["op_id", "time"], by)
    grid = once.groupBy("op_id").agg(F.min("time").alias("a"), F.max("time").alias("b")).select("op_id", F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("time"))
    w = W.partitionBy("op_id").orderBy("time").rowsBetween(W.unboundedPreceding, 0)
    full = grid.join(once.select("op_id", "time", *variables), ["op_id", "time"], "left")
    return full.select("op_id", "time", *[F.last(v, ignorenulls=True).over(w).alias(v) for v in variables])


def at_station(rows: DataFrame, weather: DataFrame, op: str, prefix: str, snapshot: str = "snapshot_ts", variables=VARIABLES) -> DataFrame:
    """rows with the values of the hour of the snapshot at the station in column ``op``."""
    w = weather.select(F.col("op_id").alias("_op"), F.col("time").alias("_time"), *[F.col(v).alias(f"{prefix}_{v}") for v in variables])
    return rows.join(w, (F.col(op) == F.col("_op")) & (F.date_trunc("HOUR", F.col(snapshot)).cast("timestamp_ntz") == F.col("_time")), "left").drop("_op", "_time")


def blend(rows: DataFrame, prev: str, nxt: str, placeholder: int = -1, variables=VARIABLES) -> DataFrame:
    """The mean of both stations, or the only one that is a real stop."""
    return rows.withColumns({v: F.when(F.col(prev) == placeholder, F.col(f"next_{v}")).when(F.col(nxt) == placeholder, F.col(f"prev_{v}")).otherwise((F.col(f"prev_{v}") + F.col(f"next_{v}")) / 2.0) for v in variables})


def missing_hours(rows: DataFrame, weather: DataFrame, snapshot: str = "snapshot_ts") -> DataFrame:
    """Hours of snapshots for which no station has a row: must be empty for the strict blend."""
    hours = rows.select(F.date_trunc("HOUR", F.col(snapshot)).cast("timestamp_ntz").alias("time")).distinct()
    return hours.join(weather.select("time").distinct(), "time", "left_anti")
