"""Queries over the network: links, nodes, transitions, paths, positions and crowding."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import first_token, micros
from ..operators import geometry, graphs, journeys, network
from ..sources import scratch
from . import adapter as A
from .registry import query
from .snapshot_queries import ACT, BASE, JRN, KEY, split

BOTH = "edges AS (SELECT u_node_id AS src, v_node_id AS dst, 'uv' AS direction, link_id, distance_m, line_id FROM links UNION ALL SELECT v_node_id, u_node_id, 'vu', link_id, distance_m, line_id FROM links)"
TRANS = """tr AS (SELECT * FROM (SELECT train_id, service_date, seq, op_id, event_type, lead(op_id) OVER w AS to_op_id, row_number() OVER w - 1 AS pos FROM ev WINDOW w AS (PARTITION BY train_id, service_date ORDER BY observed_ts, planned_ts, seq)) WHERE to_op_id IS NOT NULL)"""


#: Cheapest paths by rounds: the best walk of at most r links from each source, for each wanted line; the last link of a
#: path costs less where it lies on that line. Written apart from the engine's search.
COST = "metres * CASE WHEN line_id <> line THEN 1 WHEN {} THEN 0.55 ELSE 0.65 END::DOUBLE"
PATHS = f"""req AS (SELECT DISTINCT op_id AS src, to_op_id AS dst, CASE WHEN seq % 2 = 0 THEN 'L1' ELSE 'L2' END AS dep_line FROM tr),
roads AS (SELECT src AS a, dst AS b, link_id, link_id || direction AS token, distance_m AS metres, line_id FROM edges),
walks AS (WITH RECURSIVE walk AS (
    SELECT src AS source, dep_line AS line, src AS node, 0::DOUBLE AS cost, []::BIGINT[] AS path, []::VARCHAR[] AS toks, []::DOUBLE[] AS lens, 0 AS n FROM (SELECT DISTINCT src, dep_line FROM req)
    UNION ALL
    SELECT source, line, b, min(c), first(p ORDER BY c, a, link_id), first(t ORDER BY c, a, link_id), first(m ORDER BY c, a, link_id), n + 1 FROM (
      SELECT source, line, b, cost + {COST.format("a = source")} AS c, list_append(path, link_id) AS p, list_append(toks, token) AS t, list_append(lens, metres) AS m, a, link_id, n
      FROM walk JOIN roads ON a = node AND b <> source WHERE n < 40
      UNION ALL SELECT source, line, node, cost, path, toks, lens, -1, -1, n FROM walk WHERE node = source AND n < 40)
    GROUP BY source, line, b, n)
  SELECT * FROM walk WHERE n = 40),
found AS (SELECT r.src, r.dst, r.dep_line, first(list_append(path, link_id) ORDER BY cost + {COST.format("TRUE")}, a, link_id) AS path, first(list_append(toks, token) ORDER BY cost + {COST.format("TRUE")}, a, link_id) AS toks,
    first(list_append(lens, metres) ORDER BY cost + {COST.format("TRUE")}, a, link_id) AS lens
  FROM req r JOIN roads ON b = r.dst JOIN walks w ON w.source = r.src AND w.line = r.dep_line AND w.node = a WHERE r.src <> r.dst GROUP BY 1, 2, 3
  UNION ALL SELECT src, dst, dep_line, [], [], [] FROM req WHERE src = dst),
hop AS (SELECT tr.*, path, toks, lens, CASE WHEN seq % 2 = 0 THEN 'L1' ELSE 'L2' END AS dep_line FROM tr JOIN found f ON f.src = op_id AND f.dst = to_op_id AND f.dep_line = CASE WHEN seq % 2 = 0 THEN 'L1' ELSE 'L2' END)"""
TO_PATHS = (A.EV, A.LINKS, BOTH, TRANS, PATHS)
#: The token a train is on and the three ahead of it, and how crowded they are.
TOKENS_AHEAD = """plan AS (SELECT *, lead(planned_ts) OVER (PARTITION BY train_id, service_date ORDER BY seq) AS to_planned FROM ev),
way AS (SELECT h.train_id, h.service_date, pos, toks, lens, h.op_id, planned_ts, to_planned,
    first_value(path[1] IGNORE NULLS) OVER (PARTITION BY h.train_id, h.service_date ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS coming
  FROM hop h JOIN plan USING (train_id, service_date, seq)),
here AS (SELECT l.*, coalesce(p.n, 0) - 1 AS event, coalesce(f.planned_ts, a.end_planned_ts + INTERVAL 5 MINUTE) AS planned_1,
    row_number() OVER (PARTITION BY l.snapshot_ts ORDER BY l.service_date, l.train_id) AS journey_ord
  FROM lkd l JOIN active a USING (train_id, service_date, snapshot_ts)
  LEFT JOIN (SELECT train_id, service_date, snapshot_ts, count(*) AS n FROM pst GROUP BY ALL) p USING (train_id, service_date, snapshot_ts)
  LEFT JOIN (SELECT * FROM fut WHERE slot = 1) f USING (train_id, service_date, snapshot_ts)),
late AS (SELECT here.*, pos, toks, lens, op_id, coming, (epoch_us(to_planned) - epoch_us(planned_ts)) / 1e6 AS planned_sec,
    greatest(0, epoch_us(snapshot_ts) / 1e6 - (epoch_us(planned_ts) / 1e6 + last_known_delay)) AS passed
  FROM here JOIN way USING (train_id, service_date) WHERE pos >= event),
piece AS (SELECT *, CASE WHEN len(toks) = 0 THEN ['STOPPED@op' || op_id || 'to' || coalesce(coming::VARCHAR, 'END')]
    WHEN pos <> event OR len(toks) = 1 THEN toks
    ELSE toks[least(len(toks) - 1, len(list_filter(range(1, len(lens) + 1), lambda k: planned_sec * list_sum(lens[1:k]) / list_sum(lens) < passed))) + 1:] END AS part FROM late),
ahead AS (SELECT train_id, service_date, snapshot_ts, flatten(list(part ORDER BY pos)) AS parts FROM piece GROUP BY ALL),
tok AS (SELECT here.*, list_resize(((CASE WHEN event < 0 AND parts IS NOT NULL THEN [''] ELSE [] END) || coalesce(parts, []))[1:4], 4, '') AS tokens FROM here LEFT JOIN ahead USING (train_id, service_date, snapshot_ts)),
first_tok AS (SELECT *, CASE WHEN tokens[1] = '' THEN 0 ELSE row_number() OVER w - 1 END AS n_ahead, CASE WHEN tokens[1] <> '' THEN avg(last_known_delay) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS mean_ahead
  FROM tok WINDOW w AS (PARTITION BY snapshot_ts, tokens[1] ORDER BY planned_1, journey_ord)),
on_link AS (SELECT snapshot_ts, tokens[1] AS tok, count(*) AS n_on, avg(last_known_delay) AS mean_on FROM tok WHERE tokens[1] <> '' GROUP BY 1, 2)"""
TO_TOKENS = (*BASE, A.LINKS, BOTH, TRANS, PATHS, TOKENS_AHEAD)


def transitions(spark, sf):
    return journeys.transitions(A.events(spark, sf))


def requests(spark, sf, t=None):
    """Distinct path requests: a journey's line is L1 or L2 by its parity. t: the transitions, where they are there already."""
    line = F.when(F.col("seq") % 2 == 0, "L1").otherwise("L2")
    return (transitions(spark, sf) if t is None else t).select(F.col("op_id").alias("src"), F.col("to_op_id").alias("dst"), line.alias("dep_line"), line.alias("arr_line")).distinct()


def lined(t):
    """Transitions with the lines that their path is asked for."""
    line = F.when(F.col("seq") % 2 == 0, "L1").otherwise("L2")
    return t.withColumns({"dep_line": line, "arr_line": line})


def hops(t, links):
    """(train_id, service_date, hops) of transitions: the tokens of every transition's path, each path searched once."""
    t = lined(t)
    asked = t.select(F.col("op_id").alias("src"), F.col("to_op_id").alias("dst"), "dep_line", "arr_line").distinct()
    found = network.reachable(network.paths(asked, network.both_ways(links)))
    return network.journey_hops(t, network.path_tokens(found, links), KEY)


def deduced(spark, sf, t=None, links=None):
    """(train_id, service_date, deduced_paths): one path for each transition, in order. t, links: the transitions and the network, where they are there already."""
    t = (transitions(spark, sf) if t is None else t).withColumn("dep_line", F.when(F.col("seq") % 2 == 0, "L1").otherwise("L2"))
    p = network.reachable(network.paths(requests(spark, sf, t), network.both_ways(A.links(spark, sf) if links is None else links)))
    t = t.join(p, (t.op_id == p.src) & (t.to_op_id == p.dst) & (t.dep_line == p.dep_line)).select(*KEY, "pos", "path")
    return t.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]).alias("deduced_paths"))


@query("g01_directed_links", A.with_ctes(A.LINKS, BOTH, tail="SELECT * FROM edges"))
def directed(spark, sf):
    return network.both_ways(A.links(spark, sf))


@query("w14_transitions", A.with_ctes(A.EV, TRANS, tail="SELECT train_id, service_date, pos, op_id, to_op_id FROM tr"))
def transition_pairs(spark, sf):
    return transitions(spark, sf).select(*KEY, F.col("pos").cast("bigint").alias("pos"), "op_id", "to_op_id")


@query("a23_unordered_edges", A.with_ctes(A.EV, TRANS, tail="SELECT least(op_id, to_op_id) AS a, greatest(op_id, to_op_id) AS b, count(*) AS n FROM tr WHERE op_id <> to_op_id GROUP BY 1, 2"))
def unordered_edges(spark, sf):
    a, b = network.unordered("op_id", "to_op_id")
    return transitions(spark, sf).where("op_id <> to_op_id").groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"))


@query("d08_event_edges_vs_links", A.with_ctes(A.EV, A.LINKS, TRANS, "e AS (SELECT DISTINCT least(op_id, to_op_id) AS a, greatest(op_id, to_op_id) AS b FROM tr WHERE op_id <> to_op_id), l AS (SELECT DISTINCT least(u_node_id, v_node_id) AS a, greatest(u_node_id, v_node_id) AS b FROM links)", tail="SELECT count(*) FILTER (WHERE l.a IS NOT NULL AND e.a IS NOT NULL) AS in_both, count(*) FILTER (WHERE l.a IS NULL) AS events_only, count(*) FILTER (WHERE e.a IS NULL) AS links_only FROM e FULL JOIN l ON e.a = l.a AND e.b = l.b"))
def edges_vs_links(spark, sf):
    pair = lambda df, u, v: df.where(F.col(u) != F.col(v)).select(*[c.alias(n) for c, n in zip(network.unordered(u, v), ("a", "b"), strict=True)]).distinct()
    e, li = pair(transitions(spark, sf), "op_id", "to_op_id").withColumn("e", F.lit(1)), pair(A.links(spark, sf), "u_node_id", "v_node_id").withColumn("l", F.lit(1))
    return e.join(li, ["a", "b"], "full_outer").agg(F.count_if(F.col("e").isNotNull() & F.col("l").isNotNull()).alias("in_both"), F.count_if(F.col("l").isNull()).alias("events_only"), F.count_if(F.col("e").isNull()).alias("links_only"))


@query("j17_unordered_lookup", A.with_ctes(A.EV, A.LINKS, TRANS, "l AS (SELECT least(u_node_id, v_node_id) AS a, greatest(u_node_id, v_node_id) AS b, max(link_id) AS link_id FROM links GROUP BY 1, 2)", tail="SELECT train_id, service_date, pos, link_id FROM tr LEFT JOIN l ON a = least(op_id, to_op_id) AND b = greatest(op_id, to_op_id)"))
def unordered_lookup(spark, sf):
    a, b = network.unordered("u_node_id", "v_node_id")
    li = A.links(spark, sf).groupBy(a.alias("a"), b.alias("b")).agg(F.max("link_id").alias("link_id"))
    x, y = network.unordered("op_id", "to_op_id")
    return transitions(spark, sf).withColumns({"a": x, "b": y}).join(li, ["a", "b"], "left").select(*KEY, F.col("pos").cast("bigint").alias("pos"), "link_id")


@query("d10_most_parallel_pair", A.with_ctes(A.LINKS, tail="SELECT least(u_node_id, v_node_id) AS a, greatest(u_node_id, v_node_id) AS b, count(*) AS n, list(link_id ORDER BY link_id) AS link_ids FROM links GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 1"))
def parallel_pair(spark, sf):
    a, b = network.unordered("u_node_id", "v_node_id")
    return A.links(spark, sf).groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("link_id")).alias("link_ids")).orderBy(F.desc("n"), "a", "b").limit(1)


@query("u05_station_ids", A.with_ctes(A.LINKS, tail="SELECT u_node_id AS op_id FROM links UNION SELECT v_node_id FROM links"))
def station_ids(spark, sf):
    li = A.links(spark, sf)
    return li.select(F.col("u_node_id").alias("op_id")).union(li.select("v_node_id")).distinct()


@query("g13_bearings", A.with_ctes(A.LINKS, A.NODES, tail="SELECT link_id, round(sin(atan2(v.lat - u.lat, v.lon - u.lon)), 6) AS sin_uv, round(cos(atan2(v.lat - u.lat, v.lon - u.lon)), 6) AS cos_uv FROM links JOIN nodes u ON u.op_id = u_node_id JOIN nodes v ON v.op_id = v_node_id"))
def bearings(spark, sf):
    n = A.nodes(spark, sf)
    end = lambda c, p: n.select(F.col("op_id").alias(c), F.col("lat").alias(f"{p}lat"), F.col("lon").alias(f"{p}lon"))
    j = A.links(spark, sf).join(end("u_node_id", "u"), "u_node_id").join(end("v_node_id", "v"), "v_node_id")
    s, c = geometry.bearing(F.col("ulat"), F.col("ulon"), F.col("vlat"), F.col("vlon"))
    return j.select("link_id", F.round(s, 6).alias("sin_uv"), F.round(c, 6).alias("cos_uv"))


HAV = "2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h))"


@query("g06_node_links", A.with_ctes(A.NODES, "v AS (SELECT op_id // 10 AS section, op_id % 10 AS pos, lat, lon, CASE WHEN op_id % 10 IN (0, 3, 4, 9) THEN op_id END AS op FROM nodes), s AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM v WINDOW w AS (PARTITION BY section ORDER BY pos)), h AS (SELECT *, coalesce(pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2), 0) AS h FROM s), c AS (SELECT *, sum(" + HAV + ") OVER (PARTITION BY section ORDER BY pos) AS along FROM h), m AS (SELECT section, pos, op AS u, lead(op) OVER w AS v, lead(along) OVER w - along AS d FROM c WHERE op IS NOT NULL WINDOW w AS (PARTITION BY section ORDER BY pos))", tail="SELECT row_number() OVER (ORDER BY section, pos) AS link_id, u AS u_node_id, v AS v_node_id, 'S' || section AS line_section_id, round(d, 4) AS distance_m FROM m WHERE v IS NOT NULL"))
def node_links(spark, sf):
    n = A.nodes(spark, sf)
    matched = F.when((F.col("op_id") % 10).isin(0, 3, 4, 9), F.col("op_id"))
    v = n.withColumn("section", F.floor(F.col("op_id") / 10).cast("bigint")).groupBy("section").agg(F.array_sort(F.collect_list(F.struct((F.col("op_id") % 10).alias("k"), "lon", "lat", matched.alias("op_id")))).alias("vertices"))
    s = v.select(F.col("section").alias("section_order"), F.concat(F.lit("S"), F.col("section")).alias("line_section_id"), F.transform("vertices", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"), x["op_id"].alias("op_id"))).alias("vertices"))
    return network.node_links(s).withColumn("distance_m", F.round("distance_m", 4))


@query("g07_complete_nodes", A.with_ctes(A.NODES, "raw AS (SELECT * FROM nodes WHERE op_id % 4 <> 0), ends AS (SELECT op_id, 'E' || op_id AS name, lat, lon FROM nodes WHERE op_id % 8 = 0)", A.EV, "seen AS (SELECT DISTINCT op_id FROM ev)", tail="SELECT op_id, coalesce(raw.op_name, ends.name, CASE WHEN s.op_id IS NOT NULL THEN 'ev' || op_id END) AS op_name, raw.op_type, coalesce(ends.lat, raw.lat) AS lat, coalesce(ends.lon, raw.lon) AS lon FROM raw FULL JOIN ends USING (op_id) FULL JOIN seen s USING (op_id)"))
def complete_nodes(spark, sf):
    n = A.nodes(spark, sf)
    ends = n.where("op_id % 8 = 0").select("op_id", F.concat(F.lit("E"), F.col("op_id")).alias("name"), "lat", "lon", F.lit(0).alias("section_order"))
    seen = A.events(spark, sf).select("op_id", F.concat(F.lit("ev"), F.col("op_id")).alias("op_name"), "seq")
    return network.complete_nodes(n.where("op_id % 4 <> 0"), ends, seen)


@query("a28_unique_names", A.with_ctes(A.NODES, tail="SELECT op_id, CASE WHEN k = 1 THEN op_name ELSE op_name || '_' || k END AS op_name FROM (SELECT *, row_number() OVER (PARTITION BY op_name ORDER BY op_id) AS k FROM nodes)"))
def unique_names(spark, sf):
    return network.unique_names(A.nodes(spark, sf)).select("op_id", "op_name")


@query("p16_override_places", A.with_ctes(A.NODES, tail="SELECT op_id, op_name, CASE WHEN op_id = 5 THEN 50.5 WHEN op_id = 7 THEN 50.25 ELSE lat END AS lat, CASE WHEN op_id = 5 THEN 4.5 WHEN op_id = 7 THEN 4.25 ELSE lon END AS lon FROM nodes WHERE op_id NOT IN (11, 13)"))
def override_places(spark, sf):
    places = spark.sql("SELECT * FROM VALUES (5L, 50.5D, 4.5D), (7L, 50.25D, 4.25D) AS t(op_id, lat, lon)")
    gone = spark.sql("SELECT explode(array(11L, 13L)) AS op_id")
    return network.override_places(A.nodes(spark, sf), places).join(gone, "op_id", "left_anti").select("op_id", "op_name", "lat", "lon")


@query("j22_missing_references", A.with_ctes(A.LINKS, A.NODES, "n AS (SELECT op_id FROM nodes WHERE op_id % 9 <> 0)", tail="SELECT DISTINCT op_id FROM (SELECT u_node_id AS op_id FROM links UNION ALL SELECT v_node_id FROM links) ANTI JOIN n USING (op_id)"))
def missing_references(spark, sf):
    li, n = A.links(spark, sf), A.nodes(spark, sf).where("op_id % 9 <> 0").select("op_id")
    return li.select(F.explode(F.array("u_node_id", "v_node_id")).alias("op_id")).join(n, "op_id", "left_anti").distinct()


@query("j20_exact_place_join", A.with_ctes(A.NODES, tail="SELECT a.op_id, min(b.op_id) AS match FROM nodes a JOIN nodes b ON round(a.lon, 9) = round(b.lon, 9) AND round(a.lat, 9) = round(b.lat, 9) GROUP BY 1"))
def exact_place(spark, sf):
    at = lambda c: F.round(F.col(c), 9)
    n = A.nodes(spark, sf)
    b = n.select(F.col("op_id").alias("b"), at("lon").alias("x"), at("lat").alias("y"))
    return n.select("op_id", at("lon").alias("x"), at("lat").alias("y")).join(b, ["x", "y"]).groupBy("op_id").agg(F.min("b").alias("match"))


@query("g02_biased_paths", A.with_ctes(*TO_PATHS, tail="SELECT src, dst, dep_line, dep_line AS arr_line, len(path) AS n_links, array_to_string(path, ',') AS path FROM found"))
def biased_paths(spark, sf):
    p = network.paths(requests(spark, sf), network.both_ways(A.links(spark, sf)))
    return p.select("src", "dst", "dep_line", "arr_line", F.size("path").cast("bigint").alias("n_links"), F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query("g05_deduced_paths", A.with_ctes(*TO_PATHS, tail="SELECT train_id, service_date, count(*) AS n_transitions, string_agg(array_to_string(path, ','), ';' ORDER BY pos) AS paths FROM hop GROUP BY 1, 2"))
def deduced_paths(spark, sf):
    text = F.array_join(F.transform("deduced_paths", lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), ",")), ";")
    return deduced(spark, sf).select(*KEY, F.size("deduced_paths").cast("bigint").alias("n_transitions"), text.alias("paths"))


@query("w13_next_segment", A.with_ctes(*TO_PATHS, tail="SELECT train_id, service_date, first(path[1] ORDER BY pos) FILTER (WHERE len(path) > 0) AS first_link FROM hop GROUP BY 1, 2"))
def next_segment(spark, sf):
    return deduced(spark, sf).select(*KEY, first_token(F.flatten("deduced_paths")).alias("first_link"))


@query("j18_path_lengths", A.with_ctes(*TO_PATHS, tail="SELECT train_id, service_date, sum(list_sum(lens)) AS distance_m FROM hop WHERE len(lens) > 0 GROUP BY 1, 2"))
def path_lengths(spark, sf):
    li = A.links(spark, sf).select("link_id", "distance_m")
    return deduced(spark, sf).select(*KEY, F.explode(F.flatten("deduced_paths")).alias("link_id")).join(li, "link_id").groupBy(*KEY).agg(F.sum("distance_m").alias("distance_m"))


@query("d09_traversals_per_active_day", A.with_ctes(*TO_PATHS, "d AS (SELECT service_date, unnest(path) AS link_id FROM hop), n AS (SELECT link_id, service_date, count(*) AS n FROM d GROUP BY 1, 2)", tail="SELECT link_id, round(avg(n), 8) AS per_active_day, count(*) AS days FROM n GROUP BY 1"))
def traversals(spark, sf):
    d = deduced(spark, sf).select("service_date", F.explode(F.flatten("deduced_paths")).alias("link_id")).groupBy("link_id", "service_date").agg(F.count("*").alias("n"))
    return d.groupBy("link_id").agg(F.round(F.avg("n"), 8).alias("per_active_day"), F.count("*").alias("days"))


def tokens(spark, sf, size=4, past=1, future=1, keep=()):
    """Active journeys with their tokens, and what else the split of the journey has (keep). Events are scanned once, into a table of journeys."""
    arrays, links = scratch.stored(graphs.journey_arrays(A.events(spark, sf)), "journeys"), scratch.stored(A.links(spark, sf), "links")
    s = split(spark, sf, past, future, arrays, ("relation",)).join(hops(graphs.transitions_of(arrays), links), KEY, "left")
    s = network.with_tokens(s, size, past)
    w = W.partitionBy("snapshot_ts").orderBy("service_date", "train_id")
    return s.select(*KEY, "snapshot_ts", "last_known_delay", F.col("future_slots")[0]["planned_ts"].alias("planned_1"), "tokens", F.row_number().over(w).cast("bigint").alias("journey_ord"), *keep)


@query("g11_link_tokens", A.with_ctes(*TO_TOKENS, tail="SELECT train_id, service_date, snapshot_ts, array_to_string(tokens, ' ') AS tokens FROM tok"))
def link_tokens(spark, sf):
    return tokens(spark, sf).select(*KEY, "snapshot_ts", F.array_join("tokens", " ").alias("tokens"))


@query("w06_trains_ahead", A.with_ctes(*TO_TOKENS, tail="SELECT snapshot_ts, journey_ord, tokens[1] AS tok, n_ahead AS n_trains, round(mean_ahead, 6) AS mean_delay FROM first_tok WHERE tokens[1] <> ''"))
def trains_ahead(spark, sf):
    rows = network.ahead(tokens(spark, sf)).where("tok0 <> ''")
    return rows.select("snapshot_ts", "journey_ord", F.col("tok0").alias("tok"), F.col("n_ahead").alias("n_trains"), F.round("mean_ahead", 6).alias("mean_delay"))


@query("j19_trains_on_next_links", A.with_ctes(*TO_TOKENS, "s AS (SELECT snapshot_ts, journey_ord, unnest([1, 2, 3]) AS link_slot, tokens FROM tok)", tail="SELECT s.snapshot_ts, journey_ord, link_slot::BIGINT AS link_slot, tokens[link_slot + 1] AS tok, coalesce(n_on, 0) AS n_trains, round(mean_on, 6) AS mean_delay FROM s LEFT JOIN on_link o ON o.snapshot_ts = s.snapshot_ts AND o.tok = tokens[link_slot + 1] WHERE tokens[link_slot + 1] <> ''"))
def trains_on_links(spark, sf):
    rows = network.crowding(tokens(spark, sf)).where("link_slot > 0 and tok <> ''")
    return rows.select("snapshot_ts", "journey_ord", F.col("link_slot").cast("bigint").alias("link_slot"), "tok", "n_trains", F.round("mean_delay", 6).alias("mean_delay"))


@query("a13_counts_by_link_token", A.with_ctes(*TO_TOKENS, tail="SELECT snapshot_ts, tok, n_on AS n, round(mean_on, 6) AS mean_delay FROM on_link"))
def counts_by_link_token(spark, sf):
    """Trains on each link, direction or stop at each snapshot, and their mean delay."""
    on = tokens(spark, sf).select("snapshot_ts", F.col("tokens")[0].alias("tok"), "last_known_delay").where("tok <> ''")
    return on.groupBy("snapshot_ts", "tok").agg(F.count("*").alias("n"), F.round(F.avg("last_known_delay"), 6).alias("mean_delay"))


OPS = "wt AS (SELECT active.train_id, active.service_date, snapshot_ts, split, active.start_op_id % 20 AS tok, row_number() OVER (PARTITION BY snapshot_ts, active.start_op_id % 20 ORDER BY start_planned_ts, active.service_date, active.train_id) AS k, max_delay_sec AS d FROM active)"


@query("w06_ahead_by_start_station", A.with_ctes(A.EV, A.SNAP, JRN, ACT, OPS, tail="SELECT train_id, service_date, snapshot_ts, k - 1 AS n_ahead, sum(d) OVER (PARTITION BY snapshot_ts, tok ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS sum_ahead FROM wt"))
def ahead_by_station(spark, sf):
    from .snapshot_queries import active

    w = W.partitionBy("snapshot_ts", F.col("start_op_id") % 20).orderBy("start_planned_ts", "service_date", "train_id")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    return active(spark, sf).select(*KEY, "snapshot_ts", (F.row_number().over(w) - 1).cast("bigint").alias("n_ahead"), F.sum("max_delay_sec").over(before).alias("sum_ahead"))


@query("a13_counts_by_token", A.with_ctes(A.EV, A.SNAP, JRN, ACT, OPS, tail="SELECT snapshot_ts, tok, count(*) AS n, sum(d)::BIGINT AS delay_sum FROM wt GROUP BY 1, 2"))
def counts_by_token(spark, sf):
    from .snapshot_queries import active

    return active(spark, sf).groupBy("snapshot_ts", (F.col("start_op_id") % 20).alias("tok")).agg(F.count("*").alias("n"), F.sum("max_delay_sec").alias("delay_sum"))


@query("j14_snapshot_station_grid", A.with_ctes(A.EV, A.SNAP, JRN, ACT, A.NODES, "c AS (SELECT snapshot_ts, start_op_id AS op_id, count(*) AS n FROM active GROUP BY 1, 2)", tail="SELECT snapshot_ts, op_id, coalesce(n, 0) AS n_trains FROM snap CROSS JOIN nodes LEFT JOIN c USING (snapshot_ts, op_id)"))
def station_grid(spark, sf):
    from .snapshot_queries import active

    c = active(spark, sf).groupBy("snapshot_ts", F.col("start_op_id").alias("op_id")).agg(F.count("*").alias("n"))
    grid = A.snapshots(spark).select("snapshot_ts").crossJoin(A.nodes(spark, sf).select("op_id"))  # a dense grid is the feature
    return grid.join(c, ["snapshot_ts", "op_id"], "left").select("snapshot_ts", "op_id", F.coalesce("n", F.lit(0)).alias("n_trains"))


@query("g14_station_embedding")
def station_embedding(spark, sf):
    emb = geometry.laplacian_embedding(geometry.shipped_edges(A.links(spark, sf)))
    return spark.createDataFrame([(k, v) for k, v in emb.items()], "op_id bigint, embedding array<double>").select("op_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"))


HALF = """v AS (SELECT op_id // 10 AS section, op_id, lon, lat, lag(lon) OVER w AS lo, lag(lat) OVER w AS la FROM nodes WINDOW w AS (PARTITION BY op_id // 10 ORDER BY op_id)),
c AS (SELECT *, sum(coalesce(sqrt((lon - lo) ** 2 + (lat - la) ** 2), 0)) OVER (PARTITION BY section ORDER BY op_id) AS along FROM v),
h AS (SELECT *, max(along) OVER (PARTITION BY section) / 2 AS half, lag(along) OVER (PARTITION BY section ORDER BY op_id) AS before FROM c)"""


@query("g16_point_on_line", A.with_ctes(A.NODES, HALF, tail="SELECT section, round(lo + (half - before) / (along - before) * (lon - lo), 6) AS lon, round(la + (half - before) / (along - before) * (lat - la), 6) AS lat FROM h WHERE before < half AND along >= half"))
def point_on_line(spark, sf):
    n = A.nodes(spark, sf)
    line = n.groupBy(F.floor(F.col("op_id") / 10).alias("section")).agg(F.transform(F.array_sort(F.collect_list(F.struct("op_id", "lon", "lat"))), lambda x: F.array(x["lon"], x["lat"])).alias("line"))
    return line.withColumn("p", geometry.interpolate("line", F.lit(0.5))).select("section", F.round(F.col("p")[0], 6).alias("lon"), F.round(F.col("p")[1], 6).alias("lat"))


@query("g19_line_lengths", A.with_ctes(A.NODES, "s AS (SELECT op_id // 10 AS section, lat, lon, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM nodes WINDOW w AS (PARTITION BY op_id // 10 ORDER BY op_id)), h AS (SELECT section, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2) AS h FROM s WHERE la IS NOT NULL)", tail="SELECT section, round(sum(" + HAV + ") / 1000, 5) AS km FROM h GROUP BY section"))
def line_lengths(spark, sf):
    n = A.nodes(spark, sf)
    line = n.groupBy(F.floor(F.col("op_id") / 10).alias("section")).agg(F.transform(F.array_sort(F.collect_list(F.struct("op_id", "lon", "lat"))), lambda x: F.array(x["lon"], x["lat"])).alias("line"))
    return line.select("section", F.round(geometry.length_km(F.col("line")), 5).alias("km"))


@query("d03_box_overlap", A.with_ctes(A.NODES, tail="SELECT op_id // 10 AS section FROM nodes GROUP BY 1 HAVING max(lon) >= 4.2 AND min(lon) <= 4.4 AND max(lat) >= 50.1 AND min(lat) <= 50.2"))
def box_overlap(spark, sf):
    n = A.nodes(spark, sf)
    line = n.groupBy(F.floor(F.col("op_id") / 10).alias("section")).agg(F.collect_list(F.array("lon", "lat")).alias("line"))
    return line.where(geometry.box_overlaps(F.col("line"), 4.2, 50.1, 4.4, 50.2)).select("section")


@query("g08_snap_sections")
def snap_sections(spark, sf):
    n = A.nodes(spark, sf)
    s = n.groupBy(F.floor(F.col("op_id") / 10).alias("k")).agg(F.min("op_id").alias("op_begin_id"), F.max("op_id").alias("op_end_id"), F.transform(F.array_sort(F.collect_list(F.struct("op_id", "lon", "lat"))), lambda x: F.array(x["lon"], x["lat"])).alias("points"))
    out = geometry.snap_sections(s.select(F.col("k").cast("string").alias("line_section_id"), "op_begin_id", "op_end_id", "points"), n)
    return out.select("line_section_id", F.size("vertices").alias("n_vertices"), F.size(F.array_compact("matched_op_node_ids")).alias("n_matched"))


TOKENS = """t AS (SELECT seq, CASE seq % 4 WHEN 0 THEN '' WHEN 1 THEN 'STOPPED@op' || op_id || 'toEND' WHEN 2 THEN (op_id + 1) || 'uv' ELSE (op_id + 101) || 'vu' END AS tok FROM ev)"""


@query("g12_token_length", A.with_ctes(A.EV, A.LINKS, TOKENS, tail="SELECT seq, tok, CASE WHEN tok = '' OR tok LIKE 'STOPPED@%' THEN 0 ELSE distance_m END AS metres FROM t LEFT JOIN links ON link_id = try_cast(left(tok, length(tok) - 2) AS BIGINT)"))
def token_length(spark, sf):
    e, kind = A.events(spark, sf), F.col("seq") % 4
    tok = F.when(kind == 0, "").when(kind == 1, F.format_string("STOPPED@op%dtoEND", "op_id")).when(kind == 2, F.format_string("%duv", F.col("op_id") + 1)).otherwise(F.format_string("%dvu", F.col("op_id") + 101))
    return network.token_lengths(e.select("seq", tok.alias("tok")), A.links(spark, sf))


SEEN = """near AS (SELECT train_id, first(op_id ORDER BY observed_ts DESC, seq DESC) FILTER (WHERE observed_ts < now) AS a, max(observed_ts) FILTER (WHERE observed_ts < now) AS a_ts,
    first(op_id ORDER BY observed_ts, seq) FILTER (WHERE observed_ts > now) AS b, min(observed_ts) FILTER (WHERE observed_ts > now) AS b_ts
  FROM ev, (SELECT TIMESTAMP '2024-01-10 12:00:00' AS now) WHERE observed_ts BETWEEN now - INTERVAL 12 HOUR AND now + INTERVAL 12 HOUR GROUP BY 1),
spot AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-10 12:00:00') - epoch_us(a_ts)) / (epoch_us(b_ts) - epoch_us(a_ts)) AS share FROM near WHERE a <> b),
l AS (SELECT least(u_node_id, v_node_id) AS lo, greatest(u_node_id, v_node_id) AS hi, max(link_id) AS link_id FROM links GROUP BY 1, 2)"""


@query("g17_train_places", A.with_ctes(A.EV, A.NODES, A.LINKS, SEEN, tail="SELECT train_id, link_id, round(u.lon + share * (v.lon - u.lon), 6) AS lon, round(u.lat + share * (v.lat - u.lat), 6) AS lat FROM spot JOIN nodes u ON u.op_id = a JOIN nodes v ON v.op_id = b LEFT JOIN l ON lo = least(a, b) AND hi = greatest(a, b)"))
def train_places(spark, sf):
    """Where each train is at a moment: last event before, first after, and the point between their stations by share of time."""
    now = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    e = A.events(spark, sf).where(F.col("observed_ts").between(now - F.expr("INTERVAL 12 HOURS"), now + F.expr("INTERVAL 12 HOURS")))
    event = F.struct("observed_ts", "seq", "op_id")
    g = e.groupBy("train_id").agg(F.max(F.when(F.col("observed_ts") < now, event)).alias("a"), F.min(F.when(F.col("observed_ts") > now, event)).alias("b")).where("a.op_id <> b.op_id")
    share = (micros(now) - micros(F.col("a.observed_ts"))) / (micros(F.col("b.observed_ts")) - micros(F.col("a.observed_ts")))
    g = g.select("train_id", F.col("a.op_id").alias("u"), F.col("b.op_id").alias("v"), share.alias("share"), *[c.alias(n) for c, n in zip(network.unordered("a.op_id", "b.op_id"), ("lo", "hi"), strict=True)])
    lo, hi = network.unordered("u_node_id", "v_node_id")
    links = A.links(spark, sf).groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.max("link_id").alias("link_id"))
    side = lambda n: A.nodes(spark, sf).select(F.col("op_id").alias(n), F.col("lon").alias(f"{n}_lon"), F.col("lat").alias(f"{n}_lat"))
    out = g.join(side("u"), "u").join(side("v"), "v").join(links, ["lo", "hi"], "left")
    between = lambda c: F.round(F.col(f"u_{c}") + F.col("share") * (F.col(f"v_{c}") - F.col(f"u_{c}")), 6).alias(c)
    return out.select("train_id", "link_id", between("lon"), between("lat"))


PARTS = """p AS (SELECT op_id // 10 AS section, list([lon, lat] ORDER BY op_id) AS pts FROM nodes GROUP BY 1),
q AS (SELECT section, pts, section * 3 % 10 AS a, section * 7 % 10 AS b FROM p),
s AS (SELECT section, CASE WHEN a <= b THEN pts[a + 1 : b + 1] ELSE list_reverse(pts[b + 1 : a + 1]) END AS part FROM q)"""


@query("g18_link_polyline", A.with_ctes(A.NODES, PARTS, tail="SELECT section, len(part) AS n_points, part[1][1] AS first_lon, part[len(part)][2] AS last_lat FROM s"))
def link_polyline(spark, sf):
    """The part of a section's line between two of its vertices, in the link's direction."""
    n = A.nodes(spark, sf).withColumn("section", F.floor(F.col("op_id") / 10))
    line = n.groupBy("section").agg(F.transform(F.array_sort(F.collect_list(F.struct("op_id", "lon", "lat"))), lambda x: F.array(x["lon"], x["lat"])).alias("line"))
    part = geometry.sub_line("line", F.col("section") * 3 % 10, F.col("section") * 7 % 10)
    return line.select("section", part.alias("part")).select("section", F.size("part").cast("bigint").alias("n_points"), F.col("part")[0][0].alias("first_lon"), F.element_at("part", -1)[1].alias("last_lat"))
