"""Joins of points with intervals, merged intervals and seeded sampling of active seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import from_micros, micros

HOUR_US, DAY_S = 3_600_000_000, 86_400


def join_active(intervals: DataFrame, points: DataFrame, point: str = "snapshot_ts", start: str = "appearance_start", end: str = "disappearance_end", bucket_us: int = 6 * HOUR_US, how: str = "inner") -> DataFrame:
    """Points inside [start, end): an equi join on time buckets and a residual filter, never a nested loop.

    An interval is filed under every bucket it touches, a point under its own, so each pair meets
    once. ``left_semi`` keeps the intervals that hold any point.
    """
    of = lambda us: F.floor(us / bucket_us)
    spans = F.sequence(of(micros(F.col(start))), of(micros(F.col(end)) - 1))
    filed = intervals.where(F.col(start) < F.col(end)).withColumn("_b", F.explode(spans))
    placed = points.select(point, *[c for c in points.columns if c not in (point, *intervals.columns)]).withColumn("_pb", of(micros(F.col(point))))
    inside = (F.col("_b") == F.col("_pb")) & (F.col(start) <= F.col(point)) & (F.col(point) < F.col(end))
    out = filed.join(placed, inside, how)
    return out.drop("_b").distinct() if how == "left_semi" else out.drop("_b", "_pb")


def merge_intervals(rows: DataFrame, start: str, end: str, keys=()) -> DataFrame:
    """Overlapping or touching intervals as one, per key: (keys, start, end, n)."""
    w = W.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    out = rows.where(F.col(start) < F.col(end)).withColumn("_new", F.coalesce((before < F.col(start)).cast("int"), F.lit(1)))
    out = out.withColumn("_g", F.sum("_new").over(w))
    return out.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_g")


def merge_by_day(rows: DataFrame, start: str, end: str) -> DataFrame:
    """``merge_intervals`` without a key, and without a task that holds all intervals: (start, end, n).

    Intervals are cut at midnight and merged day by day; then only the merged stretches, one for each gap in service
    and each midnight, are joined where they touch. An interval counts in the stretch it begins in."""
    day = 24 * HOUR_US
    of = rows.where(F.col(start) < F.col(end)).select(micros(F.col(start)).alias("a"), micros(F.col(end)).alias("z"))
    days = F.sequence(F.floor(F.col("a") / day), F.floor((F.col("z") - 1) / day))
    pieces = of.select("a", "z", F.explode(days).alias("k"))
    pieces = pieces.select(F.greatest("a", F.col("k") * day).alias("s"), F.least("z", (F.col("k") + 1) * day).alias("e"), "k", (F.floor(F.col("a") / day) == F.col("k")).cast("int").alias("begins"))
    w = W.partitionBy("k").orderBy("s", "e")
    new = F.coalesce((F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1)) < F.col("s")).cast("int"), F.lit(1))
    pieces = pieces.withColumn("new", new).withColumn("g", F.sum("new").over(w))
    stretches = pieces.groupBy("k", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("begins").alias("n"))
    over = W.orderBy("s")  # of stretches, not of intervals
    stretches = stretches.withColumn("apart", F.coalesce((F.lag("e").over(over) < F.col("s")).cast("int"), F.lit(1)))
    stretches = stretches.withColumn("whole", F.sum("apart").over(over))
    out = stretches.groupBy("whole").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n"))
    return out.select(from_micros(F.col("s")).alias(start), from_micros(F.col("e")).alias(end), "n")


def sample_active_seconds(intervals: DataFrame, low_us: int, high_us: int, n: int, rng, start: str = "appearance_start", end: str = "disappearance_end") -> list[int]:
    """n different seconds in [low, high) at which any interval is active, sorted, drawn with a NumPy generator.

    Intervals are cut at midnight and merged day by day, so no task holds them all. Merged stretches are few
    (one for each gap in service and each midnight) and are the only thing collected.
    """
    if n <= 0:
        return []
    import numpy as np

    up = lambda c: F.ceil(micros(F.col(c)) / 1_000_000)
    low, high = low_us // 1_000_000, high_us // 1_000_000
    if high <= low:
        raise ValueError("the split has no whole second")
    clip = lambda c: F.greatest(F.lit(low), F.least(F.lit(high), c)).cast("long")
    rows = intervals.select(clip(up(start)).alias("a"), clip(up(end)).alias("z")).where("a < z")
    days = F.sequence(F.floor(F.col("a") / DAY_S), F.floor((F.col("z") - 1) / DAY_S))
    rows = rows.select("a", "z", F.explode(days).alias("k"))
    rows = rows.select(F.greatest("a", F.col("k") * DAY_S).alias("s"), F.least("z", (F.col("k") + 1) * DAY_S).alias("e"), "k")
    spans = merge_intervals(rows, "s", "e", ("k",))
    spans = sorted((r.s, r.e) for r in spans.select("s", "e").collect())
    lengths = np.array([e - s for s, e in spans], np.int64)
    total = int(lengths.sum())
    if total < n:
        raise ValueError(f"{n} snapshots asked for, {total} active seconds there")
    ends = np.cumsum(lengths)
    picked = np.sort(rng.choice(total, size=n, replace=False))
    which = np.searchsorted(ends, picked, side="right")
    return [int(spans[k][0] + i - (ends[k] - lengths[k])) for k, i in zip(which, picked, strict=True)]
