"""Journey summaries, transitions and activity windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import from_micros, micros
from .clean import JOURNEY, ordered


def summarise(events: DataFrame, keys=JOURNEY) -> DataFrame:
    """One row a journey: first and last stop and times in row order, size, delay bounds."""
    known = lambda c, f: f(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq")))
    return events.groupBy(*keys).agg(
        known("op_id", F.min_by).alias("start_op_id"), known("op_id", F.max_by).alias("end_op_id"),
        known("planned_ts", F.min_by).alias("start_planned_ts"), known("planned_ts", F.max_by).alias("end_planned_ts"),
        known("observed_ts", F.min_by).alias("start_observed_ts"), known("observed_ts", F.max_by).alias("end_observed_ts"),
        F.count("*").alias("events_count"), F.max("delay_sec").alias("max_delay_sec"), F.min("delay_sec").alias("min_delay_sec"),
    )


def transitions(events: DataFrame, keys=JOURNEY, by=("observed_ts", "planned_ts", "seq")) -> DataFrame:
    """Each event with its follower: (.., to_*) and the position of the transition from 0."""
    w = W.partitionBy(*keys).orderBy(*by)
    nxt = {f"to_{c}": F.lead(c).over(w) for c in ("op_id", "event_type", "planned_ts", "observed_ts", "arr_line_id") if c in events.columns}
    return events.withColumns(nxt | {"pos": F.row_number().over(w) - 1, "last": F.lead("seq").over(w).isNull()}).where(~F.col("last")).drop("last")


def activity(journeys: DataFrame, idle_before_min: int = 0, idle_after_min: int = 5) -> DataFrame:
    """journeys with appearance_start (inclusive) and disappearance_end (exclusive)."""
    start = F.least(micros(F.col("start_planned_ts")) - idle_before_min * 60_000_000, micros(F.col("start_observed_ts")))
    return journeys.withColumns({"appearance_start": from_micros(start), "disappearance_end": from_micros(micros(F.col("end_observed_ts")) + idle_after_min * 60_000_000)})


def event_arrays(events: DataFrame, keys=JOURNEY, columns=("observed_ts", "op_id", "planned_ts", "delay_sec", "event_type")) -> DataFrame:
    """One row a journey with its events as an array of structs in row order."""
    return events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", *columns))).alias("events"))


__all__ = ["summarise", "transitions", "activity", "event_arrays", "ordered"]


def key_runs(rows: DataFrame, within: list[str], key: str, order: str) -> DataFrame:
    """Contiguous runs of equal keys in the order of a column: (within, run, key, start, length), starts counted from 0.

    A key that comes back later has several runs."""
    w = W.partitionBy(*within).orderBy(order)
    begins = (~F.lag(key).over(w).eqNullSafe(F.col(key)) | (F.row_number().over(w) == 1)).cast("int")
    rows = rows.withColumns({"_begins": begins, "_pos": F.row_number().over(w) - 1})
    rows = rows.withColumn("run", F.sum("_begins").over(w))
    return rows.groupBy(*within, "run").agg(F.first(key).alias(key), F.min("_pos").cast("bigint").alias("start"), F.count("*").alias("length"))
