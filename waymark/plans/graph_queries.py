"""Queries over graph tables, mergeable statistics and tables by month."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, intervals, journeys, network, statistics
from ..sources import months, scratch
from . import adapter as A
from .network_queries import TO_TOKENS, hops
from .registry import query
from .snapshot_queries import BASE, KEY
from .weather_queries import HOURLY, hourly

FEATURES, LAYOUT = graphs.FEATURES, graphs.LAYOUT
_root = lambda x: f"sign({x}) * sqrt(abs({x}))"
_row = lambda table, *cells: ", ".join([*(f"({c})::DOUBLE AS f{k + 1}" for k, c in enumerate(cells)), *(f"NULL::DOUBLE AS f{k + 1}" for k in range(len(cells), graphs.WIDTH))])
_ANGLE = "(extract(hour FROM snapshot_ts) + extract(minute FROM snapshot_ts) / 60.0 + extract(second FROM snapshot_ts) / 3600.0) / 24.0 * 6.283185307179586"
_TURN = "atan2(v.lat - u.lat, v.lon - u.lon)"
_SINCE = "(epoch_us(planned_ts) - epoch_us(snapshot_ts)) / 1e6"
_KINDS = [f"event_type = '{k}'" for k in ("A", "D", "P")]
GRAPH = f"""num AS (SELECT train_id, service_date, snapshot_ts, split, last_known_delay, tokens, journey_ord - 1 AS node FROM tok),
stopped AS (
  SELECT snapshot_ts, regexp_extract(tokens[1], '^STOPPED@op([0-9]+)to', 1)::BIGINT AS op_id, count(*) AS n, avg(last_known_delay) AS d
  FROM num WHERE tokens[1] LIKE 'STOPPED@op%' GROUP BY 1, 2),
graph AS (
  SELECT 'train_nodes' AS tbl, split, snapshot_ts, node AS a, NULL::BIGINT AS b, NULL::BIGINT AS slot,
    {_row("train_nodes", _root("last_known_delay"), f"sin({_ANGLE})", f"cos({_ANGLE})", *[f"train_id::BIGINT % 5 = {k}" for k in range(5)])}
  FROM num
  UNION ALL
  SELECT 'station_nodes', split, snap.snapshot_ts, nodes.op_id, NULL, NULL,
    {_row("station_nodes", "lat", "lon", "temperature_2m", "coalesce(n, 0)", _root("coalesce(d, 0)"))}
  FROM snap CROSS JOIN nodes LEFT JOIN stopped s ON s.snapshot_ts = snap.snapshot_ts AND s.op_id = nodes.op_id
  LEFT JOIN hourly h ON h.op_id = nodes.op_id % 10 AND h.time = date_trunc('hour', snap.snapshot_ts)
  UNION ALL
  SELECT 'station_links', split, snap.snapshot_ts, link_id, u_node_id, v_node_id,
    {_row("station_links", "distance_m", f"sin({_TURN})", f"cos({_TURN})", "coalesce(uv.n_on, 0)", "coalesce(vu.n_on, 0)", _root("coalesce(uv.mean_on, 0)"), _root("coalesce(vu.mean_on, 0)"))}
  FROM snap CROSS JOIN links JOIN nodes u ON u.op_id = u_node_id JOIN nodes v ON v.op_id = v_node_id
  LEFT JOIN on_link uv ON uv.snapshot_ts = snap.snapshot_ts AND uv.tok = link_id || 'uv'
  LEFT JOIN on_link vu ON vu.snapshot_ts = snap.snapshot_ts AND vu.tok = link_id || 'vu'
  UNION ALL
  SELECT 'past_edges', split, snapshot_ts, node, op_id, slot, {_row("past_edges", "slot", _root(_SINCE), _root("delay_sec"), *_KINDS)}
  FROM pst JOIN num USING (train_id, service_date, snapshot_ts) WHERE slot <= 3
  UNION ALL
  SELECT 'future_edges', num.split, snapshot_ts, node, op_id, slot, {_row("future_edges", "slot", _root(_SINCE), *_KINDS, _root("delay_sec - last_known_delay"))}
  FROM fut JOIN num USING (train_id, service_date, snapshot_ts) WHERE slot <= 3)"""
TO_GRAPH = (*TO_TOKENS, A.NODES, A.WX, HOURLY, GRAPH)
_rounded = lambda c: f"round({c}, 5) + 0.0::DOUBLE"


def parts(spark, sf):
    """The five tables. Events are scanned once, into journeys; train states are a table as well, which all five read."""
    arrays = scratch.stored(graphs.journey_arrays(A.events(spark, sf)), "journeys")
    links = A.links(spark, sf)
    live = graphs.states(arrays, A.snapshots(spark), 3, 3).join(hops(graphs.transitions_of(arrays), links), KEY, "left")
    live = scratch.stored(network.with_tokens(live, 4, 3).drop("hops"), "states")
    nodes = A.nodes(spark, sf).select("op_id", "lat", "lon", (F.col("op_id") % 10).alias("weather_op"))
    return graphs.tables(live, A.snapshots(spark), nodes, links, hourly(spark, sf))


def shown(rows):
    return rows.select(*LAYOUT, *[(F.round(f, 5) + F.lit(0.0)).alias(f) for f in FEATURES])


@query("n17_graph_tables", A.with_ctes(*TO_GRAPH, tail=f"SELECT {', '.join(LAYOUT)}, {', '.join(f'{_rounded(f)} AS {f}' for f in FEATURES)} FROM graph"))
def graph_tables(spark, sf):
    """Train nodes, station nodes, links and both kinds of edges of every snapshot."""
    return shown(graphs.union(parts(spark, sf)))


_LEARNED = "learned AS (SELECT tbl, " + ", ".join(f"avg({f}) AS {f}_m, stddev_samp({f}) AS {f}_d, min({f}) AS {f}_l, max({f}) AS {f}_h" for f in FEATURES) + " FROM graph WHERE split = 'train' GROUP BY tbl)"


def _scaled(f: str) -> str:
    of = lambda norm: ", ".join(f"'{t}'" for t, fs in graphs.TABLES.items() for g, m in zip(FEATURES, fs.values(), strict=False) if g == f and m == norm) or "''"
    z = f"CASE WHEN {f}_d > 0 THEN ({f} - {f}_m) / {f}_d ELSE {f} - {f}_m END"
    span = f"CASE WHEN {f}_h > {f}_l THEN greatest(0, least(1, ({f} - {f}_l) / ({f}_h - {f}_l))) ELSE 0 END"
    return f"{_rounded(f'CASE WHEN tbl IN ({of("z")}) THEN {z} WHEN tbl IN ({of("range")}) AND {f} IS NOT NULL THEN {span} ELSE {f} END')} AS {f}"


@query("n18_normalised_tables", A.with_ctes(*TO_GRAPH, _LEARNED, tail=f"SELECT {', '.join(LAYOUT)}, {', '.join(map(_scaled, FEATURES))} FROM graph JOIN learned USING (tbl)"))
def normalised_tables(spark, sf):
    """All tables scaled by what the train snapshots say (one aggregate for all), written by split and table in one job, read back."""
    rows = scratch.stored(graphs.union(parts(spark, sf)), "graphtables")
    to = scratch.new_path(spark, "graphexport")
    graphs.export(graphs.normalised(rows, graphs.feature_statistics(rows)), to)
    back = spark.read.schema(rows.schema).parquet(to)
    return shown(back)


@query("n17_table_statistics", A.with_ctes(*TO_GRAPH, tail="SELECT tbl, 'f' || k AS \"column\", count(x) AS n, round(avg(x), 5) + 0.0::DOUBLE AS mean, round(CASE WHEN count(x) = 1 THEN 0 ELSE stddev_samp(x) END, 5) AS std, min(x) AS low, max(x) AS high FROM (SELECT tbl, split, unnest(range(1, " + str(graphs.WIDTH + 1) + ")) AS k, unnest([" + ", ".join(FEATURES) + "]) AS x FROM graph) WHERE split = 'train' GROUP BY 1, 2"))
def table_statistics(spark, sf):
    """Count, mean, deviation and ends of every feature over the train snapshots."""
    s = graphs.feature_statistics(graphs.union(parts(spark, sf)))
    return s.select("tbl", "column", "n", (F.round("mean", 5) + F.lit(0.0)).alias("mean"), F.round("std", 5).alias("std"), "low", "high")


ARRAYS = """spots AS (SELECT snapshot_ts, op_id, row_number() OVER (PARTITION BY snapshot_ts ORDER BY op_id) - 1 AS place FROM snap CROSS JOIN nodes),
one_way AS (
  SELECT replace(tbl, '_edges', '') AS rel, g.snapshot_ts, g.a AS src, place AS dst, slot AS o FROM graph g JOIN spots s ON s.snapshot_ts = g.snapshot_ts AND s.op_id = g.b WHERE tbl IN ('past_edges', 'future_edges')
  UNION ALL SELECT 'to', g.snapshot_ts, u.place, v.place, g.a FROM graph g JOIN spots u ON u.snapshot_ts = g.snapshot_ts AND u.op_id = g.b JOIN spots v ON v.snapshot_ts = g.snapshot_ts AND v.op_id = g.slot WHERE tbl = 'station_links'),
ed AS (SELECT * FROM one_way UNION ALL SELECT rel || '_rev', snapshot_ts, dst, src, o FROM one_way),
src AS (
  SELECT rel, snapshot_ts, a AS src FROM graph CROSS JOIN (SELECT unnest(['past', 'future']) AS rel) WHERE tbl = 'train_nodes'
  UNION ALL SELECT rel, snapshot_ts, place FROM spots CROSS JOIN (SELECT unnest(['past_rev', 'future_rev', 'to', 'to_rev']) AS rel)),
deg AS (SELECT rel, snapshot_ts, src, count(*) AS n FROM ed GROUP BY ALL),
starts AS (SELECT rel, snapshot_ts, src, coalesce(n, 0) AS n, coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY rel, snapshot_ts ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM src LEFT JOIN deg USING (rel, snapshot_ts, src)),
csr AS (
  SELECT rel, snapshot_ts, offsets, coalesce(neighbours, []) AS neighbours
  FROM (SELECT rel, snapshot_ts, list_append(list(start ORDER BY src), sum(n)::BIGINT) AS offsets FROM starts GROUP BY 1, 2)
  LEFT JOIN (SELECT rel, snapshot_ts, list(dst ORDER BY src, o, dst) AS neighbours FROM ed GROUP BY 1, 2) USING (rel, snapshot_ts)),
aims AS (SELECT snapshot_ts, list(round(f6, 5) + 0.0::DOUBLE ORDER BY a, slot) AS targets FROM graph WHERE tbl = 'future_edges' GROUP BY 1)"""
RELATIONS = ("past", "past_rev", "future", "future_rev", "to", "to_rev")


@query("n14_graph_arrays", A.with_ctes(*TO_GRAPH, ARRAYS, tail="SELECT snapshot_ts, (SELECT list(op_id ORDER BY op_id) FROM nodes) AS stations, targets, " + ", ".join(f"any_value({c}) FILTER (WHERE rel = '{r}') AS {r}_{c}" for r in RELATIONS for c in ("offsets", "neighbours")) + " FROM csr LEFT JOIN aims USING (snapshot_ts) GROUP BY snapshot_ts, targets"))
def graph_arrays(spark, sf):
    """One row for each snapshot, written in files of a bounded number of graphs and read back: compressed edges of six relations between local numbers."""
    g = graphs.graph_rows({k: scratch.stored(v, k) for k, v in parts(spark, sf).items()})
    to = scratch.new_path(spark, "graphs")
    graphs.write_graphs(g, to)
    back = spark.read.schema(g.schema).parquet(to)
    return back.withColumn("targets", F.transform("targets", lambda y: F.round(y, 5) + F.lit(0.0)))


MEASURES = ("delay_sec", "root")


@query("a08_merged_statistics", A.with_ctes(A.EV, f"x AS (SELECT event_type, delay_sec::DOUBLE AS delay_sec, {_root('delay_sec')} AS root FROM ev)", tail=" UNION ALL ".join(f"SELECT event_type, '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 8) AS mean, round(stddev_samp({c}), 8) AS std, min({c}) AS low, max({c}) AS high FROM x GROUP BY event_type" for c in MEASURES)))
def merged_statistics(spark, sf):
    """Statistics by day are stored; one day is stored again, the others stay as they are; all are merged and finished."""
    from ..functions.scalars import signed_sqrt

    e = A.events(spark, sf).select("service_date", "event_type", F.col("delay_sec").cast("double").alias("delay_sec"), signed_sqrt(F.col("delay_sec").cast("double")).alias("root"))
    to = scratch.new_path(spark, "statistics")
    by = ["service_date", "event_type"]
    wrong = F.when(F.col("service_date") == "2024-01-15", F.col("delay_sec") + 1000).otherwise(F.col("delay_sec"))  # a day that was loaded badly
    parts_ = statistics.partials(e.withColumn("delay_sec", wrong), list(MEASURES), by)
    statistics.store(parts_, to, "service_date")
    statistics.store(statistics.partials(e.where("service_date = '2024-01-15'"), list(MEASURES), by), to, "service_date")
    stored = spark.read.schema(parts_.schema).parquet(to)
    out = statistics.finished(statistics.merged(stored, ["event_type"]))
    return out.select("event_type", "column", "n", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"), "low", "high")


def by_month(spark, sf):
    """(path, schema) of the events in folders by month of their service day."""
    e = A.events(spark, sf)
    to = scratch.new_path(spark, "months")
    months.write_months(e, to)
    return to, ", ".join(f"{n} {t}" for n, t in e.dtypes)


_MONTHS = "m AS (SELECT DISTINCT strftime(snapshot_ts, '%Y%m') AS month FROM snap), jm AS (SELECT train_id, service_date, min(month) AS month FROM ev GROUP BY 1, 2)"


@query("n03_month_scan", A.with_ctes(*BASE[:4], _MONTHS, tail="SELECT a.train_id, a.service_date, a.snapshot_ts, events_count FROM active a JOIN jm USING (train_id, service_date) SEMI JOIN m USING (month)"))
def month_scan(spark, sf):
    """Journeys active at a snapshot, read from a table by month: only folders of months with snapshots are opened, and once."""
    to, schema = by_month(spark, sf)
    wanted = A.snapshots(spark).select(F.date_format("snapshot_ts", "yyyyMM").alias("month"))
    events = months.read_months(spark, to, schema, wanted)
    live = intervals.join_active(journeys.activity(journeys.summarise(events), 5, 5), A.snapshots(spark))
    return live.select(*KEY, "snapshot_ts", "events_count")


@query("s06_month_folders", A.with_ctes(A.EV, tail="SELECT service_date, count(*) AS n FROM ev WHERE month = '202401' GROUP BY 1"))
def month_folders(spark, sf):
    """A filter on the month opens the folder of that month alone."""
    to, schema = by_month(spark, sf)
    return months.read_months(spark, to, schema).where("month = '202401'").groupBy("service_date").agg(F.count("*").alias("n"))
