"""Delays over a stream of events. An extension: the batch engine does not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delay_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """events(observed_ts timestamp, op_id, delay_sec): count and mean by station and tumbling window, late rows dropped by the watermark."""
    g = events.withWatermark("observed_ts", late).groupBy(F.window("observed_ts", width), "op_id")
    return g.agg(F.count("*").alias("n"), F.sum("delay_sec").alias("delay_sum")).select(F.col("window.start").alias("window_start"), "op_id", "n", "delay_sum")


def running_delay(events: DataFrame, late: str = "6 hours") -> DataFrame:
    """For each journey the latest observed time so far and its delay, never running backward. The watermark lets go of
    the state of past days."""
    day = F.window("observed_ts", "1 day")
    last = F.max(F.struct(F.unix_micros("observed_ts").alias("observed_us"), F.col("delay_sec").cast("bigint").alias("delay_sec"))).alias("last")
    g = events.withWatermark("observed_ts", late).groupBy(day.alias("day"), "train_id", "service_date").agg(last)
    return g.select("train_id", "service_date", "last.observed_us", "last.delay_sec")
