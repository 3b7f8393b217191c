"""Point-in-time views: padded past and future slots of every journey active at a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import from_micros, last_known_delay, micros

PLACEHOLDER = -1


def padded(arrays: DataFrame, past: int, future: int, idle_before_min: int = 0, idle_after_min: int = 5) -> DataFrame:
    """arrays(.., events) with ``padded``: placeholders before the first and after the last event.

    Past placeholders: time and plan before the start, delay 0, type D. Future ones: after the
    end, last delay, type A.
    """
    before, after = idle_before_min * 60_000_000, idle_after_min * 60_000_000
    first, last = F.element_at("events", 1), F.element_at("events", -1)
    struct = lambda ts, plan, delay, kind: F.struct(ts.alias("observed_ts"), F.lit(PLACEHOLDER).cast("bigint").alias("op_id"), plan.alias("planned_ts"), delay.cast("double").alias("delay_sec"), F.lit(kind).alias("event_type"))
    start = F.least(micros(first["observed_ts"]), micros(first["planned_ts"]) - before)
    head = struct(from_micros(start), from_micros(micros(first["planned_ts"]) - before), F.lit(0.0), "D")
    tail = struct(from_micros(micros(last["observed_ts"]) + after), from_micros(micros(last["planned_ts"]) + after), last["delay_sec"], "A")
    body = F.transform("events", lambda e: F.struct(e["observed_ts"].alias("observed_ts"), e["op_id"].cast("bigint").alias("op_id"), e["planned_ts"].alias("planned_ts"), e["delay_sec"].cast("double").alias("delay_sec"), e["event_type"].alias("event_type")))
    return arrays.withColumn("padded", F.concat(F.array_repeat(head, past), body, F.array_repeat(tail, future)))


def split_at(active: DataFrame, past: int, future: int, snapshot: str = "snapshot_ts") -> DataFrame:
    """active(.., padded, snapshot) with past_slots (nearest first), future_slots and the position of the split."""
    out = active.withColumn("split_idx", F.size(F.filter("padded", lambda e: e["observed_ts"] <= F.col(snapshot))))
    return out.withColumns({"past_slots": F.reverse(F.slice("padded", F.col("split_idx") - past + 1, past)), "future_slots": F.slice("padded", F.col("split_idx") + 1, future)})


def with_last_delay(split: DataFrame, snapshot: str = "snapshot_ts") -> DataFrame:
    now, nxt = F.element_at("past_slots", 1), F.element_at("future_slots", 1)
    return split.withColumn("last_known_delay", last_known_delay(now["delay_sec"], F.col(snapshot), nxt["planned_ts"]))


def long_targets(split: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each future slot: slot from 1, its event, delay NULL at a placeholder."""
    out = split.select(*keep, F.posexplode("future_slots").alias("_p", "e"))
    real = F.col("e.op_id") != PLACEHOLDER
    return out.select(*keep, (F.col("_p") + 1).alias("slot"), F.when(real, F.col("e.observed_ts")).alias("future_obs_ts"), F.col("e.op_id").alias("future_op_id"), F.col("e.event_type").alias("future_event_type"), F.when(real, F.col("e.delay_sec")).alias("future_delay"))


def wide_targets(long: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """The evaluation table: four columns for each slot. Slots are named, so the pivot needs no extra pass."""
    pick = lambda c, k: F.max(F.when(F.col("slot") == k, F.col(c))).alias(f"{c}_{k}")
    return long.groupBy(*keys).agg(*[pick(c, k) for k in range(1, slots + 1) for c in ("future_obs_ts", "future_op_id", "future_event_type", "future_delay")])
