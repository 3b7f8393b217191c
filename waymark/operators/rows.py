"""The full tabular row of a train at a snapshot: every feature family, the targets, and the row as sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import features, network, snapshots, weather


def _kinds(event: Column, prefix: str) -> list[Column]:
    """Indicators of a slot's event type, all 0 at a placeholder."""
    real = event["op_id"] != snapshots.PLACEHOLDER
    return [F.coalesce((real & (event["event_type"] == k)).cast("int"), F.lit(0)).alias(f"{prefix}_event_type_{k}") for k in S.EVENT_TYPES]


def columns(past: int, future: int, links: int) -> dict[str, list[str]]:
    """Names by what is done to them: ``z`` and ``range`` are scaled, ``as_is`` are not, ``target`` are what is learned."""
    slots = [(f"past_{k + 1}", "past") for k in range(past)] + [(f"future_{k + 1}", "future") for k in range(future)]
    time = [f"snapshot_{unit}_{f}_{k}" for unit in ("hour", "year") for k in S.FREQUENCIES for f in ("sin", "cos")]
    return {
        "z": ["last_known_delay", *[f"past_delay_sec_{k + 1}" for k in range(past)], *[f"{s}_planned_delta" for s, _ in slots], *[f"link_{k}_{n}" for k in range(links) for n in ("n_trains", "mean_delay")], "weather_temperature_2m"],
        "range": [f"link_{k}_metres" for k in range(links)],
        "as_is": [*time, *[f"snapshot_day_{d}" for d in S.WEEKDAYS], *[f"train_relation_{t}" for t in S.RELATION_TYPES], *[f"{s}_event_type_{k}" for s, _ in slots for k in S.EVENT_TYPES]],
        "target": [f"y_{k + 1}" for k in range(future)],
    }


def full(states: DataFrame, links: DataFrame, hourly: DataFrame, past: int, future: int, n_links: int, weather_op, keys=("train_id", "service_date")) -> DataFrame:
    """states(keys, snapshot_ts, split, node, relation, last_known_delay, past_slots, future_slots, tokens) -> one wide row each.

    hourly: weather(op_id, time, temperature_2m); ``weather_op`` turns a station's id into that of its weather."""
    rows = states.withColumns({"journey_ord": F.col("node"), "planned_1": F.col("future_slots")[0]["planned_ts"]})
    slot = lambda c, k: F.col(c)[k]
    delta = lambda e: S.signed_sqrt(S.seconds_between(e["planned_ts"], F.col("snapshot_ts")))
    ways = [("past_slots", k, f"past_{k + 1}") for k in range(past)] + [("future_slots", k, f"future_{k + 1}") for k in range(future)]
    cells = [S.signed_sqrt(slot("past_slots", k)["delay_sec"]).alias(f"past_delay_sec_{k + 1}") for k in range(past)]
    cells += [delta(slot(c, k)).alias(f"{name}_planned_delta") for c, k, name in ways] + [x for c, k, name in ways for x in _kinds(slot(c, k), name)]
    cells += [S.signed_sqrt(F.when(slot("future_slots", k)["op_id"] != snapshots.PLACEHOLDER, slot("future_slots", k)["delay_sec"]) - F.col("last_known_delay")).alias(f"y_{k + 1}") for k in range(future)]
    cells += S.cyclic(S.day_fraction(F.col("snapshot_ts")), "snapshot_hour") + S.cyclic(S.year_fraction(F.col("snapshot_ts")), "snapshot_year")
    cells += S.indicators(F.date_format("snapshot_ts", "EEEE"), S.WEEKDAYS, "snapshot_day") + S.indicators(S.relation_type(F.col("relation")), S.RELATION_TYPES, "train_relation")
    station = lambda c: F.when(slot(c, 0)["op_id"] == snapshots.PLACEHOLDER, snapshots.PLACEHOLDER).otherwise(weather_op(slot(c, 0)["op_id"])).cast("bigint")
    base = rows.select(*keys, "snapshot_ts", "split", "node", S.signed_sqrt(F.col("last_known_delay")).alias("last_known_delay"), *cells, station("past_slots").alias("prev_op"), station("future_slots").alias("next_op"))

    crowd = network.token_lengths(network.crowding(rows), links)
    at = lambda c, k: F.max(F.when(F.col("link_slot") == k, F.col(c)))
    crowd = crowd.groupBy("snapshot_ts", F.col("journey_ord").alias("node")).agg(*[x for k in range(n_links) for x in (at("n_trains", k).cast("double").alias(f"link_{k}_n_trains"), S.signed_sqrt(F.coalesce(at("mean_delay", k), F.lit(0.0))).alias(f"link_{k}_mean_delay"), at("metres", k).alias(f"link_{k}_metres"))])
    out = base.join(crowd, ["snapshot_ts", "node"])
    var = ("temperature_2m",)
    out = weather.at_station(weather.at_station(out, hourly, "prev_op", "prev", variables=var), hourly, "next_op", "next", variables=var)
    out = weather.blend(out, "prev_op", "next_op", variables=var).withColumnRenamed("temperature_2m", "weather_temperature_2m")
    names = columns(past, future, n_links)
    return out.select(*keys, "snapshot_ts", "split", *[c for group in names.values() for c in group])


def sequences(rows: DataFrame, past: int, future: int, keys=("train_id", "service_date")) -> DataFrame:
    """Wide rows -> ``past`` steps (oldest first; planned delta, delay, event types), ``future`` steps (planned delta, event types), and for both a mask:
    1 where the step is a real event."""
    kinds = lambda s: [F.col(f"{s}_event_type_{k}").cast("double") for k in S.EVENT_TYPES]
    real = lambda s: (sum(F.col(f"{s}_event_type_{k}") for k in S.EVENT_TYPES) > 0).cast("int")
    back = [f"past_{k + 1}" for k in reversed(range(past))]
    ahead = [f"future_{k + 1}" for k in range(future)]
    before = F.array(*[F.array(F.col(f"{s}_planned_delta"), F.col(f"past_delay_sec_{s[5:]}"), *kinds(s)) for s in back])
    after = F.array(*[F.array(F.col(f"{s}_planned_delta"), *kinds(s)) for s in ahead])
    return rows.select(*keys, "snapshot_ts", "split", before.alias("past"), F.array(*map(real, back)).alias("past_mask"), after.alias("future"), F.array(*map(real, ahead)).alias("future_mask"))


def pooled(rows: DataFrame, past: int, future: int) -> DataFrame:
    """rows with the slots of a family scaled by one set of numbers of the train rows: planned deltas before, planned deltas ahead, past delays."""
    families = {"past_planned": [f"past_{k + 1}_planned_delta" for k in range(past)], "future_planned": [f"future_{k + 1}_planned_delta" for k in range(future)], "past_delay": [f"past_delay_sec_{k + 1}" for k in range(past)]}
    stats = features.pooled(rows, families)
    flat = stats.agg(*[F.max(F.when(F.col("family") == f, F.struct("mean", "std"))).alias(f"_{f}") for f in families])
    out = rows.crossJoin(F.broadcast(flat))  # one row
    new = {c: S.z_score(F.col(c), F.col(f"_{f}.mean"), F.col(f"_{f}.std")) for f, cs in families.items() for c in cs}
    return out.withColumns(new).drop(*[f"_{f}" for f in families])


