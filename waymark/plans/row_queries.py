"""Queries over full tabular rows: all families, scaled, and as sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import features, graphs, network, rows
from ..sources import scratch
from . import adapter as A
from .network_queries import TO_TOKENS, hops
from .registry import query
from .snapshot_queries import KEY
from .weather_queries import HOURLY, NOW, VALUES, hourly

PAST = FUTURE = 3
LINKS = 4
NAMES = rows.columns(PAST, FUTURE, LINKS)
EVERY = [c for group in NAMES.values() for c in group]
_root = lambda x: f"sign({x}) * sqrt(abs({x}))"
_delta = lambda at: _root(f"(epoch_us({at}) - epoch_us(r.snapshot_ts)) / 1e6")
_DAY = "(extract(hour FROM r.snapshot_ts) + extract(minute FROM r.snapshot_ts) / 60.0 + extract(second FROM r.snapshot_ts) / 3600.0) / 24.0"
_YEAR = "extract(doy FROM r.snapshot_ts) / 365.0"


def _cells() -> dict[str, str]:
    """The SQL of every column, by name."""
    c = {"last_known_delay": _root("r.last_known_delay")}
    for k in range(1, PAST + 1):
        c[f"past_delay_sec_{k}"] = _root(f"coalesce(p{k}_delay, 0)")
        c[f"past_{k}_planned_delta"] = _delta(f"coalesce(p{k}_planned, a.start_planned_ts - INTERVAL 5 MINUTE)")
    for k in range(1, FUTURE + 1):
        c[f"future_{k}_planned_delta"] = _delta(f"coalesce(f{k}_planned, a.end_planned_ts + INTERVAL 5 MINUTE)")
        c[f"y_{k}"] = _root(f"(f{k}_delay - r.last_known_delay)")
    for way, name in (("past", "p"), ("future", "f")):
        c |= {f"{way}_{k}_event_type_{t}": f"coalesce(({name}{k}_kind = '{t}')::INT, 0)" for k in range(1, PAST + 1) for t in S.EVENT_TYPES}
    for k in range(LINKS):
        c[f"link_{k}_n_trains"] = "r.n_ahead" if k == 0 else f"coalesce(n_{k}, 0)"
        c[f"link_{k}_mean_delay"] = _root("coalesce(r.mean_ahead, 0)") if k == 0 else _root(f"coalesce(mean_{k}, 0)")
        c[f"link_{k}_metres"] = f"coalesce(metres_{k}, 0)"
    for unit, part in (("hour", _DAY), ("year", _YEAR)):
        c |= {f"snapshot_{unit}_{f}_{k}": f"{f}({part} * {6.283185307179586 * k!r})" for k in S.FREQUENCIES for f in ("sin", "cos")}
    c |= {f"snapshot_day_{d}": f"(dayname(r.snapshot_ts) = '{d}')::INT" for d in S.WEEKDAYS}
    number = {"IC": 0, "L": 1, "S": 2, "P": 3, "EXTRA": 4}
    c |= {f"train_relation_{t}": f"(r.train_id::BIGINT % 5 = {number[t]})::INT" if t in number else "0" for t in S.RELATION_TYPES}
    c["weather_temperature_2m"] = "CASE WHEN v.prev_op IS NULL THEN nt WHEN v.next_op IS NULL THEN pt ELSE (pt + nt) / 2 END"
    return c


_one = lambda when, what, name: f"max(CASE WHEN {when} THEN {what} END) AS {name}"
_SLOTS = ", ".join(_one(f"way = '{w}' AND slot = {k}", what, f"{w}{k}_{name}") for w in "pf" for k in range(1, PAST + 1) for what, name in (("planned_ts", "planned"), ("delay_sec", "delay"), ("event_type", "kind")))
_TOKENS = ", ".join(_one(f"k = {k}", what, f"{name}_{k}") for k in range(LINKS) for what, name in (("n_on", "n"), ("mean_on", "mean"), ("distance_m", "metres")))
ROW = f"""sl AS MATERIALIZED (
  SELECT train_id, service_date, snapshot_ts, {_SLOTS} FROM (
    SELECT train_id, service_date, snapshot_ts, 'p' AS way, slot, planned_ts, delay_sec, event_type FROM pst WHERE slot <= 3
    UNION ALL SELECT train_id, service_date, snapshot_ts, 'f', slot, planned_ts, delay_sec, event_type FROM fut WHERE slot <= 3)
  GROUP BY 1, 2, 3),
ways AS (SELECT link_id || 'uv' AS tok, distance_m FROM links UNION ALL SELECT link_id || 'vu', distance_m FROM links),
tl AS MATERIALIZED (
  SELECT train_id, service_date, snapshot_ts, {_TOKENS}
  FROM (SELECT train_id, service_date, snapshot_ts, unnest(range(0, {LINKS})) AS k, unnest(tokens) AS tok FROM first_tok)
  LEFT JOIN on_link USING (snapshot_ts, tok) LEFT JOIN ways USING (tok) GROUP BY 1, 2, 3),
wide AS MATERIALIZED (
  SELECT r.train_id, r.service_date, r.snapshot_ts, r.split, {", ".join(f"({sql})::DOUBLE AS {name}" for name, sql in _cells().items())}
  FROM first_tok r JOIN act a ON a.train_id = r.train_id AND a.service_date = r.service_date
  JOIN tl ON tl.train_id = r.train_id AND tl.service_date = r.service_date AND tl.snapshot_ts = r.snapshot_ts
  LEFT JOIN sl ON sl.train_id = r.train_id AND sl.service_date = r.service_date AND sl.snapshot_ts = r.snapshot_ts
  LEFT JOIN v ON v.train_id = r.train_id AND v.service_date = r.service_date AND v.snapshot_ts = r.snapshot_ts)"""
TO_ROWS = (*TO_TOKENS, A.WX, HOURLY, NOW, VALUES, ROW)
_head = "train_id, service_date, snapshot_ts, split"
_rounded = lambda x, digits=5: f"round({x}, {digits}) + 0.0::DOUBLE"


def wide(spark, sf):
    """Full rows from one scan of the events, kept as a table."""
    arrays = scratch.stored(graphs.journey_arrays(A.events(spark, sf)), "journeys")
    links = A.links(spark, sf)
    live = graphs.states(arrays, A.snapshots(spark), PAST, FUTURE).join(hops(graphs.transitions_of(arrays), links), KEY, "left")
    live = scratch.stored(network.with_tokens(live, LINKS, PAST).drop("hops"), "states")
    return scratch.stored(rows.full(live, links, hourly(spark, sf), PAST, FUTURE, LINKS, lambda op: op % 10), "rows")


def shown(df, names):
    return df.select(*KEY, "snapshot_ts", "split", *[(F.round(F.col(c).cast("double"), 5) + F.lit(0.0)).alias(c) for c in names])


@query("n06_full_rows", A.with_ctes(*TO_ROWS, tail=f"SELECT {_head}, {', '.join(f'{_rounded(c)} AS {c}' for c in EVERY)} FROM wide"))
def full_rows(spark, sf):
    """Every feature family of a train at a snapshot: time, relation, planned deltas, delays, event types, links ahead, weather; and the targets."""
    return shown(wide(spark, sf), EVERY)


_STATS = "m AS (SELECT " + ", ".join([*(f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_d" for c in NAMES["z"]), *(f"min({c}) AS {c}_l, max({c}) AS {c}_h" for c in NAMES["range"])]) + " FROM wide WHERE split = 'train')"
_Z = [f"CASE WHEN {c}_d > 0 THEN ({c} - {c}_m) / {c}_d ELSE {c} - {c}_m END" for c in NAMES["z"]]
_R = [f"CASE WHEN {c}_h > {c}_l THEN greatest(0, least(1, ({c} - {c}_l) / ({c}_h - {c}_l))) ELSE 0 END" for c in NAMES["range"]]


@query("n08_full_rows_normalised", A.with_ctes(*TO_ROWS, _STATS, tail=f"SELECT {_head}, {', '.join(f'{_rounded(x)} AS {c}' for c, x in [*zip(NAMES['z'], _Z, strict=True), *zip(NAMES['range'], _R, strict=True)])}, {', '.join(f'{_rounded(c)} AS {c}' for c in NAMES['as_is'] + NAMES['target'])} FROM wide, m"))
def full_rows_normalised(spark, sf):
    """All columns, scaled by the numbers of the train rows."""
    t = wide(spark, sf)
    return shown(features.normalise(t, features.moments(t, [*NAMES["z"], *NAMES["range"]]), NAMES["z"], NAMES["range"]), EVERY)


_FAMILIES = {"past_planned": [f"past_{k}_planned_delta" for k in range(1, PAST + 1)], "future_planned": [f"future_{k}_planned_delta" for k in range(1, FUTURE + 1)], "past_delay": [f"past_delay_sec_{k}" for k in range(1, PAST + 1)]}
_POOL = ",\n".join(f"{f} AS (SELECT avg(x) AS m, stddev_samp(x) AS d FROM (SELECT unnest([{', '.join(cs)}]) AS x FROM wide WHERE split = 'train'))" for f, cs in _FAMILIES.items())
_z = lambda c, f: f"round(({c} - {f}.m) / {f}.d, 5) + 0.0::DOUBLE"
_types = lambda s: ", ".join(f"{s}_event_type_{t}" for t in S.EVENT_TYPES)
_real = lambda s: f"({' + '.join(f'{s}_event_type_{t}' for t in S.EVENT_TYPES)} > 0)::INT"
_BACK, _AHEAD = [f"past_{k}" for k in range(PAST, 0, -1)], [f"future_{k}" for k in range(1, FUTURE + 1)]


@query(
    "n09_masked_sequences",
    A.with_ctes(
        *TO_ROWS, _POOL,
        tail=f"SELECT {_head}, [{', '.join(f'[{_z(f"{s}_planned_delta", "past_planned")}, {_z(f"past_delay_sec_{s[5:]}", "past_delay")}, {_types(s)}]' for s in _BACK)}] AS past, [{', '.join(map(_real, _BACK))}] AS past_mask, "
        f"[{', '.join(f'[{_z(f"{s}_planned_delta", "future_planned")}, {_types(s)}]' for s in _AHEAD)}] AS future, [{', '.join(map(_real, _AHEAD))}] AS future_mask FROM wide, past_planned, future_planned, past_delay",
    ),
)
def masked_sequences(spark, sf):
    """Past and future steps with masks, each family of slots scaled by one set of numbers."""
    t = rows.sequences(rows.pooled(wide(spark, sf), PAST, FUTURE), PAST, FUTURE)
    short = lambda c: F.transform(c, lambda step: F.transform(step, lambda x: F.round(x, 5) + F.lit(0.0)))
    return t.withColumns({"past": short("past"), "future": short("future")})
