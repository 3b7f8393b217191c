"""Graph tables of snapshots: trains, stations, links and edges between them, all from one table of train states.

``states`` has one row for each train and snapshot. The five tables are projections and small aggregates of it, so
events are scanned and shuffled once for all of them. Every table has the columns of ``LAYOUT``: which table, split,
snapshot, up to two ids and a slot, and features; so they are normalised, written and counted in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import geometry, intervals, journeys, snapshots, statistics

#: The features of each table in order, with what is done to them: z (score), range (to 0..1), or nothing.
TABLES = {
    "train_nodes": {"last_known_delay": "z", "hour_sin": "", "hour_cos": "", "is_ic": "", "is_l": "", "is_s": "", "is_p": "", "is_extra": ""},
    "station_nodes": {"lat": "range", "lon": "range", "temperature": "z", "n_stopped": "z", "stopped_delay": "z"},
    "station_links": {"distance": "z", "angle_sin": "", "angle_cos": "", "uv_trains": "z", "vu_trains": "z", "uv_delay": "z", "vu_delay": "z"},
    "past_edges": {"slot_no": "range", "planned_delta": "z", "delay": "z", "is_a": "", "is_d": "", "is_p": ""},
    "future_edges": {"slot_no": "range", "planned_delta": "z", "is_a": "", "is_d": "", "is_p": "", "target": ""},
}
WIDTH = max(map(len, TABLES.values()))
FEATURES = [f"f{k + 1}" for k in range(WIDTH)]
#: a: train number or station or link; b: station, or a link's first end; slot: of an edge, or a link's second end.
LAYOUT = ["tbl", "split", "snapshot_ts", "a", "b", "slot"]


def journey_arrays(events: DataFrame, keys=journeys.JOURNEY, also=()) -> DataFrame:
    """One row for each journey: its events in row order (with the columns in ``also``), its relation, and its first and last known times; one shuffle."""
    rows = journeys.event_arrays(events.withColumn("relation", F.col("train_relation")), keys, ("observed_ts", "op_id", "planned_ts", "delay_sec", "event_type", "relation", *also))
    known = lambda c: F.filter(F.col(f"events.{c}"), lambda x: x.isNotNull())
    ends = {"start_planned_ts": (known("planned_ts"), 0), "end_planned_ts": (known("planned_ts"), -1), "start_observed_ts": (known("observed_ts"), 0), "end_observed_ts": (known("observed_ts"), -1), "relation": (known("relation"), 0)}
    pick = lambda a, k: F.get(a, F.lit(0)) if k == 0 else F.get(a, F.size(a) - 1)
    return rows.withColumns({n: pick(a, k) for n, (a, k) in ends.items()})


def transitions_of(arrays: DataFrame, keys=journeys.JOURNEY) -> DataFrame:
    """Each event with its follower, as ``journeys.transitions`` has them, from journey arrays."""
    e = F.array_sort(F.transform("events", lambda x: F.struct(x["observed_ts"].alias("observed_ts"), x["planned_ts"].alias("planned_ts"), x["seq"].alias("seq"), x["op_id"].alias("op_id"))))
    pairs = F.transform(F.slice("e", 1, F.size("e") - 1), lambda x, k: F.struct(k.alias("pos"), x.alias("here"), F.get("e", k + 1).alias("there")))
    rows = arrays.withColumn("e", e).select(*keys, F.explode(pairs).alias("t"))
    return rows.select(*keys, "t.pos", F.col("t.here.seq").alias("seq"), F.col("t.here.op_id").alias("op_id"), F.col("t.there.op_id").alias("to_op_id"), F.col("t.here.planned_ts").alias("planned_ts"), F.col("t.there.planned_ts").alias("to_planned_ts"))


def states(arrays: DataFrame, points: DataFrame, past: int, future: int, idle_before_min: int = 5, idle_after_min: int = 5, keys=journeys.JOURNEY) -> DataFrame:
    """Trains active at snapshots: slots, last known delay, the events passed, and ``node``, their number in the snapshot from 0."""
    live = journeys.activity(arrays, idle_before_min, idle_after_min)
    pairs = intervals.join_active(live, points)
    rows = snapshots.with_last_delay(snapshots.split_at(snapshots.padded(pairs, past, future, idle_before_min, idle_after_min), past, future))
    node = F.row_number().over(W.partitionBy("snapshot_ts").orderBy("service_date", "train_id")) - 1
    return rows.select(*keys, "snapshot_ts", "split", node.cast("bigint").alias("node"), "relation", "last_known_delay", "split_idx", "past_slots", "future_slots")


def _laid(rows: DataFrame, table: str, a, b, slot, features: dict) -> DataFrame:
    if list(features) != list(TABLES[table]):
        raise ValueError(f"features of {table}: {list(features)}")
    cells = [c.cast("double").alias(f) for c, f in zip(features.values(), FEATURES, strict=False)] + [F.lit(None).cast("double").alias(f) for f in FEATURES[len(features) :]]
    return rows.select(F.lit(table).alias("tbl"), "split", "snapshot_ts", *[x.cast("bigint").alias(n) for n, x in (("a", a), ("b", b), ("slot", slot))], *cells)


def tables(rows: DataFrame, points: DataFrame, nodes: DataFrame, links: DataFrame, weather: DataFrame) -> dict[str, DataFrame]:
    """The five tables of states(.., tokens), points(snapshot_ts, split), nodes(op_id, lat, lon, weather_op), links and hourly weather(op_id, time, temperature_2m)."""
    none = F.lit(None)
    when = S.day_fraction(F.col("snapshot_ts")) * F.lit(6.283185307179586)
    kind = S.relation_type(F.col("relation"))
    is_ = lambda c, v: F.coalesce((c == v).cast("int"), F.lit(0))
    trains = _laid(rows, "train_nodes", F.col("node"), none, none, {"last_known_delay": S.signed_sqrt(F.col("last_known_delay")), "hour_sin": F.sin(when), "hour_cos": F.cos(when), **{f"is_{v.lower()}": is_(kind, v) for v in ("IC", "L", "S", "P", "EXTRA")}})

    on = rows.select("snapshot_ts", "last_known_delay", F.col("tokens")[0].alias("tok"))
    stop = on.withColumn("op_id", F.regexp_extract("tok", "^STOPPED@op([0-9]+)to", 1)).where("op_id <> ''")
    stop = stop.groupBy("snapshot_ts", F.col("op_id").cast("bigint").alias("op_id")).agg(F.count("*").alias("n"), F.avg("last_known_delay").alias("d"))
    sky = weather.select(F.col("op_id").alias("weather_op"), F.col("time").alias("hour"), "temperature_2m")
    grid = points.withColumn("hour", F.date_trunc("HOUR", "snapshot_ts").cast("timestamp_ntz")).crossJoin(nodes)  # every station of every snapshot is the feature
    grid = grid.join(stop, ["snapshot_ts", "op_id"], "left").join(sky, ["weather_op", "hour"], "left")
    stations = _laid(grid, "station_nodes", F.col("op_id"), none, none, {"lat": F.col("lat"), "lon": F.col("lon"), "temperature": F.col("temperature_2m"), "n_stopped": F.coalesce("n", F.lit(0)), "stopped_delay": S.signed_sqrt(F.coalesce("d", F.lit(0.0)))})

    way = on.where(F.col("tok").rlike("^[0-9]+(uv|vu)$")).select("snapshot_ts", "last_known_delay", F.regexp_extract("tok", "^([0-9]+)", 1).cast("bigint").alias("link_id"), F.right("tok", F.lit(2)).alias("way"))
    per = [x for w in ("uv", "vu") for x in (F.count_if(F.col("way") == w).alias(f"{w}_n"), F.avg(F.when(F.col("way") == w, F.col("last_known_delay"))).alias(f"{w}_d"))]
    place = lambda c, p: nodes.select(F.col("op_id").alias(c), F.col("lat").alias(f"{p}lat"), F.col("lon").alias(f"{p}lon"))
    placed = links.join(place("u_node_id", "u"), "u_node_id").join(place("v_node_id", "v"), "v_node_id")
    s, c = geometry.bearing(F.col("ulat"), F.col("ulon"), F.col("vlat"), F.col("vlon"))
    edges = points.crossJoin(placed).join(way.groupBy("snapshot_ts", "link_id").agg(*per), ["snapshot_ts", "link_id"], "left")  # every link of every snapshot is the feature
    traffic = {f"{w}_trains": F.coalesce(f"{w}_n", F.lit(0)) for w in ("uv", "vu")} | {f"{w}_delay": S.signed_sqrt(F.coalesce(f"{w}_d", F.lit(0.0))) for w in ("uv", "vu")}
    net = _laid(edges, "station_links", F.col("link_id"), F.col("u_node_id"), F.col("v_node_id"), {"distance": F.col("distance_m"), "angle_sin": s, "angle_cos": c, **traffic})

    def slots(column: str):
        out = rows.select("split", "snapshot_ts", "node", "last_known_delay", F.posexplode(column).alias("p", "e")).where(F.col("e.op_id") != snapshots.PLACEHOLDER)
        delta = S.signed_sqrt(S.seconds_between(F.col("e.planned_ts"), F.col("snapshot_ts")))
        kinds = {f"is_{v.lower()}": is_(F.col("e.event_type"), v) for v in S.EVENT_TYPES}
        return out, F.col("p") + 1, delta, kinds

    out, no, delta, kinds = slots("past_slots")
    past = _laid(out, "past_edges", F.col("node"), F.col("e.op_id"), no, {"slot_no": no, "planned_delta": delta, "delay": S.signed_sqrt(F.col("e.delay_sec")), **kinds})
    out, no, delta, kinds = slots("future_slots")
    future = _laid(out, "future_edges", F.col("node"), F.col("e.op_id"), no, {"slot_no": no, "planned_delta": delta, **kinds, "target": S.signed_sqrt(F.col("e.delay_sec") - F.col("last_known_delay"))})
    return {"train_nodes": trains, "station_nodes": stations, "station_links": net, "past_edges": past, "future_edges": future}


def union(parts: dict[str, DataFrame]) -> DataFrame:
    first, *rest = parts.values()
    for df in rest:
        first = first.unionByName(df)
    return first


def feature_statistics(rows: DataFrame, train: str = "train") -> DataFrame:
    """(tbl, column, n, mean, std, low, high) of the train rows of all tables, in one aggregate."""
    return statistics.finished(statistics.partials(rows.where(F.col("split") == train), FEATURES, ["tbl"]))


def normalised(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """rows with every feature scaled as ``TABLES`` says. stats: a row for each table and feature (a few dozen), shipped to the tasks."""
    how = [(t, f, norm) for t, features in TABLES.items() for f, norm in zip(FEATURES, features.values(), strict=False)]
    cell = F.struct("n", "mean", "std", "low", "high")
    wide = stats.groupBy(F.col("tbl").alias("_t")).agg(*[F.max(F.when(F.col("column") == f, cell)).alias(f"_{f}") for f in FEATURES])
    out = rows.join(F.broadcast(wide), F.col("tbl") == F.col("_t"), "left")
    new = {}
    for f in FEATURES:
        s, x = F.col(f"_{f}"), F.col(f)
        of = lambda norm, f=f: F.col("tbl").isin([t for t, g, m in how if g == f and m == norm])
        new[f] = F.when(x.isNull(), x).when(of("z"), S.z_score(x, s["mean"], s["std"])).when(of("range"), S.min_max(x, s["low"], s["high"])).otherwise(x)
    return out.withColumns(new).select(*rows.columns)


def export(rows: DataFrame, path: str) -> None:
    """All tables of all splits in one job, a folder for each split and table."""
    rows.write.mode("overwrite").partitionBy("split", "tbl").parquet(path)


def adjacency(edges: DataFrame, sources: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """edges(snapshot_ts, src, dst, order..) and sources(snapshot_ts, src) -> one row for each snapshot: ``offsets`` (where each source's
    edges start, and their number at the end) and ``neighbours`` (ends of the edges, sorted by source and ``by``)."""
    degree = edges.groupBy("snapshot_ts", "src").agg(F.count("*").alias("n"))
    before = W.partitionBy("snapshot_ts").orderBy("src").rowsBetween(W.unboundedPreceding, -1)
    starts = sources.join(degree, ["snapshot_ts", "src"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    starts = starts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    heads = starts.groupBy("snapshot_ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("src", "start"))), lambda x: x["start"]).alias("o"), F.sum("n").alias("m"))
    ends = edges.groupBy("snapshot_ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("src", *by, "dst"))), lambda x: x["dst"]).alias("neighbours"))
    out = heads.join(ends, "snapshot_ts", "left")
    return out.select("snapshot_ts", F.concat("o", F.array("m")).alias("offsets"), F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))


def graph_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """One row for each snapshot: train and station ids, and for each relation and its reverse the compressed edges between their places in the
    snapshot (a train's place is its number, a station's its rank by id). The edges' features are those of the tables, in the order of the edges."""
    spots = parts["station_nodes"].select("snapshot_ts", F.col("a").alias("op_id"))
    spots = spots.withColumn("place", (F.row_number().over(W.partitionBy("snapshot_ts").orderBy("op_id")) - 1).cast("bigint"))
    trains = parts["train_nodes"].select("snapshot_ts", F.col("a").alias("src"))
    at = lambda c, n: spots.select("snapshot_ts", F.col("op_id").alias(c), F.col("place").alias(n))
    stations = spots.select("snapshot_ts", F.col("place").alias("src"))
    out = spots.groupBy("snapshot_ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "op_id"))), lambda x: x["op_id"]).alias("stations"))
    relations = {}
    for name, table in (("past", "past_edges"), ("future", "future_edges")):
        e = parts[table].select("snapshot_ts", F.col("a").alias("src"), F.col("b").alias("op"), "slot").join(at("op", "dst"), ["snapshot_ts", "op"])
        relations[name] = adjacency(e, trains, ("slot",))
        relations[f"{name}_rev"] = adjacency(e.select("snapshot_ts", F.col("dst").alias("src"), F.col("src").alias("dst"), "slot"), stations, ("slot",))
    net = parts["station_links"].select("snapshot_ts", F.col("a").alias("link"), F.col("b").alias("u"), F.col("slot").alias("v"))
    net = net.join(at("u", "src"), ["snapshot_ts", "u"]).join(at("v", "dst"), ["snapshot_ts", "v"])
    relations["to"] = adjacency(net, stations, ("link",))
    relations["to_rev"] = adjacency(net.select("snapshot_ts", F.col("dst").alias("src"), F.col("src").alias("dst"), "link"), stations, ("link",))
    target = FEATURES[list(TABLES["future_edges"]).index("target")]
    target = parts["future_edges"].groupBy("snapshot_ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "slot", F.col(target).alias("y")))), lambda x: x["y"]).alias("targets"))
    for name, r in relations.items():
        out = out.join(r.select("snapshot_ts", F.col("offsets").alias(f"{name}_offsets"), F.col("neighbours").alias(f"{name}_neighbours")), "snapshot_ts", "left")
    return out.join(target, "snapshot_ts", "left")


def write_graphs(graphs: DataFrame, path: str, records: int = 128) -> None:
    """Graphs in files of at most ``records`` snapshots."""
    graphs.write.mode("overwrite").option("maxRecordsPerFile", records).parquet(path)
