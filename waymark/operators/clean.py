"""Cleaning of stop records into event rows: whole-journey rules on an explicit row order.

All rules are windows over the journey key, so one shuffle by journey serves the chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import micros, seconds_between, wall_clock

JOURNEY = ("train_id", "service_date")
CONFLICT_SEC, BACKWARD_SEC, MAX_LATE_SEC, MAX_EARLY_SEC = 120, 120, 14_400, 3_600


def whole(keys=JOURNEY):
    return W.partitionBy(*keys)


def ordered(keys=JOURNEY, by="seq"):
    return W.partitionBy(*keys).orderBy(by)


def parse_stops(raw: DataFrame) -> DataFrame:
    """Date and time texts into planned and observed timestamps."""
    pairs = {"planned_arr_ts": "sched_arrival", "planned_dep_ts": "sched_departure", "obs_arr_ts": "observed_arrival", "obs_dep_ts": "observed_departure"}
    return raw.withColumns({out: wall_clock(F.col(f"{src}_date"), F.col(f"{src}_time")) for out, src in pairs.items()})


def resolve_conflicts(stops: DataFrame, limit_sec: int = CONFLICT_SEC, keys=JOURNEY) -> DataFrame:
    """Departures planned before their arrival: small ones move the arrival, large ones drop the journey."""
    planned, observed = seconds_between(F.col("planned_arr_ts"), F.col("planned_dep_ts")), seconds_between(F.col("obs_arr_ts"), F.col("obs_dep_ts"))
    bad = F.coalesce(planned > 0, F.lit(False))
    large = bad & ((F.coalesce(planned, F.lit(0.0)) > limit_sec) | F.coalesce(observed > limit_sec, F.lit(False)))
    out = stops.withColumn("_bad", bad).withColumn("_drop", F.max(large).over(whole(keys))).where(~F.col("_drop"))
    return out.withColumns(
        {"planned_arr_ts": F.when(F.col("_bad"), F.col("planned_dep_ts")).otherwise(F.col("planned_arr_ts")), "obs_arr_ts": F.when(F.col("_bad"), F.col("obs_dep_ts")).otherwise(F.col("obs_arr_ts"))}
    ).drop("_bad", "_drop")


def stops_to_events(stops: DataFrame) -> DataFrame:
    """Each stop as a passage (equal times) or an arrival and a departure; seq orders them without a sort."""
    is_passage = F.coalesce(F.col("planned_arr_ts") == F.col("planned_dep_ts"), F.lit(False))
    none = F.lit(None).cast("string")
    event = lambda k, kind, ts, obs, arr, dep: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("event_type"), F.col(ts).alias("planned_ts"), F.col(obs).alias("observed_ts"), arr.alias("arr_line"), dep.alias("dep_line"))
    arr, dep = F.col("arr_line_id").cast("string"), F.col("dep_line_id").cast("string")
    passage = F.array(event(0, "P", "planned_arr_ts", "obs_arr_ts", arr, dep))
    both = F.array(event(1, "A", "planned_arr_ts", "obs_arr_ts", arr, none), event(2, "D", "planned_dep_ts", "obs_dep_ts", none, dep))
    events = F.when(is_passage, passage).otherwise(F.filter(both, lambda e: e["planned_ts"].isNotNull()))
    gone = {"planned_arr_ts", "planned_dep_ts", "obs_arr_ts", "obs_dep_ts", "arr_line_id", "dep_line_id", "seq"}
    rest = [c for c in stops.columns if c not in gone]
    out = stops.select(*rest, F.col("seq").alias("_s"), F.explode(events).alias("_e"))
    return out.select(*rest, (F.col("_s") * 3 + F.col("_e.k")).alias("seq"), "_e.event_type", "_e.planned_ts", "_e.observed_ts", F.col("_e.arr_line").alias("arr_line_id"), F.col("_e.dep_line").alias("dep_line_id"))


def drop_incomplete(events: DataFrame, keys=JOURNEY) -> DataFrame:
    """Journeys with any event that lacks a planned or observed time go as a whole."""
    missing = F.col("planned_ts").isNull() | F.col("observed_ts").isNull()
    return events.withColumn("_m", F.max(missing).over(whole(keys))).where(~F.col("_m")).drop("_m")


def with_streaks(events: DataFrame, column: str, top: str, streak: str, keys=JOURNEY) -> DataFrame:
    """events with ``top``, the running maximum of a time, and ``streak``, the microseconds that it has run backward without a pause (0 or less).

    Steps back are summed over the whole journey, less their sum where the last streak ended: one sort serves all."""
    w = ordered(keys)
    out = events.withColumn("_d", micros(F.col(column)) - F.lag(micros(F.col(column))).over(w))
    out = out.withColumns({"_back": F.sum(F.least(F.coalesce("_d", F.lit(0)), F.lit(0))).over(w), top: F.max(column).over(w)})
    ended = F.min(F.when(F.col("_d") >= 0, F.col("_back"))).over(w)
    return out.withColumn(streak, F.col("_back") - F.coalesce(ended, F.lit(0))).drop("_d", "_back")


def clamp_backward(events: DataFrame, column: str, limit_sec: int = BACKWARD_SEC, keys=JOURNEY) -> DataFrame:
    """Times that run backward: a streak of more than limit_sec drops the journey, others become the running maximum."""
    out = with_streaks(events, column, "_top", "_s", keys)
    out = out.withColumn("_w", F.min("_s").over(whole(keys))).where(F.col("_w") >= -max(limit_sec, 0) * 1_000_000)
    return out.withColumn(column, F.col("_top")).drop("_top", "_s", "_w")


def add_delay(events: DataFrame) -> DataFrame:
    return events.withColumn("delay_sec", seconds_between(F.col("observed_ts"), F.col("planned_ts")))


def bound_delays(events: DataFrame, max_late: int = MAX_LATE_SEC, max_early: int = MAX_EARLY_SEC, keys=JOURNEY) -> DataFrame:
    """Journeys with any delay outside the bounds go as a whole."""
    w = whole(keys)
    out = events.withColumns({"_hi": F.max("delay_sec").over(w), "_lo": F.min("delay_sec").over(w)})
    return out.where((F.col("_hi") <= max_late) & (F.col("_lo") >= -max_early)).drop("_hi", "_lo")


def keep_first(rows: DataFrame, keys, by="seq") -> DataFrame:
    """The first row of each key by an explicit order."""
    w = W.partitionBy(*keys).orderBy(by)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def keep_last(rows: DataFrame, keys, by="seq") -> DataFrame:
    return keep_first(rows, keys, F.desc(by))


def build_events(stops: DataFrame, keys=JOURNEY, params: dict | None = None, **limits) -> DataFrame:
    """The whole chain, from stop records with parsed times to clean events. params: ``PARAMETERS`` as a manifest gives them."""
    p = parameters(params)
    out = resolve_conflicts(stops, limits.get("conflict_sec", p["intra_stop_conflict_threshold_sec"]), keys) if p["apply_intra_stop_conflicts"] else stops
    out = drop_incomplete(stops_to_events(out), keys)
    for column, name in (("planned_ts", "planned_monotonic"), ("observed_ts", "observed_monotonic")):
        if p[f"apply_{name}"]:
            out = clamp_backward(out, column, limits.get("backward_sec", p[f"{name}_threshold_sec"]), keys)
    out = bound_delays(add_delay(out), limits.get("max_late", p["max_late_sec"]), limits.get("max_early", p["max_early_sec"]), keys)
    return keep_first(out, [*keys, "event_type", "op_id"])


#: What counts as yes and no, and the parameters of the cleaning chain: type, default, older names in the order they are looked for.
YES, NO = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")
PARAMETERS = {
    "intra_stop_conflict_threshold_sec": ("int", CONFLICT_SEC, ("stop_arrival_departure_conflict_threshold_sec", "schedule_skew_threshold_sec", "skew_threshold_sec")),
    "apply_intra_stop_conflicts": ("bool", True, ()),
    "planned_monotonic_threshold_sec": ("int", BACKWARD_SEC, ("schedule_monotonic_threshold_sec", "monotonic_threshold_sec")),
    "apply_planned_monotonic": ("bool", True, ()),
    "observed_monotonic_threshold_sec": ("int", BACKWARD_SEC, ("monotonic_threshold_sec",)),
    "apply_observed_monotonic": ("bool", True, ()),
    "max_late_sec": ("int", MAX_LATE_SEC, ()),
    "max_early_sec": ("int", MAX_EARLY_SEC, ()),
}


def parameters(given: dict | None, known: dict = PARAMETERS) -> dict:
    """Every known parameter with a value of its type: the given one, under its own or an older name, else the default.

    A text that is neither yes nor no leaves a switch at its default; a threshold that is no whole number is an error."""
    given, out = given or {}, {}
    for name, (kind, default, older) in known.items():
        value = next((given[n] for n in (name, *older) if n in given), None)
        if kind == "bool":
            text = str(value).strip().lower()
            out[name] = value if isinstance(value, bool) else True if text in YES else False if text in NO else default
        else:
            out[name] = default if value is None else int(value)
    return out
