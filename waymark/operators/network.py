"""The network as tables: links from section vertices, node completion, biased paths, link tokens."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import haversine_m, micros

#: Cost factors on the departure line near the source, on the arrival line near the target (each with
#: the other line second), and on a preferred line elsewhere.
NEAR_SAME, NEAR_OTHER, ALONG = 0.55, 0.75, 0.65
#: Adjacency is shipped to the tasks; a network of this many links takes about 200 MB.
MAX_SHIPPED_LINKS = 2_000_000


def node_links(sections: DataFrame) -> DataFrame:
    """sections(section_order, line_section_id, vertices array<struct<lon,lat,op_id>>) -> one link between each two
    neighbouring matched vertices, with the length along the vertices between them; link_id counts from 1."""
    v = sections.select("section_order", "line_section_id", F.posexplode("vertices").alias("pos", "v")).select("section_order", "line_section_id", "pos", "v.*")
    w = W.partitionBy("section_order", "line_section_id").orderBy("pos")
    step = F.coalesce(haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    v = v.withColumn("step", step).withColumn("along", F.sum("step").over(w)).where("op_id is not null")
    links = v.withColumns({"v_node_id": F.lead("op_id").over(w), "to": F.lead("along").over(w)}).where("v_node_id is not null")
    # numbered inside each section, and sections (a row each) by a running sum of their links
    section, key = ["section_order", "line_section_id"], lambda a, b: a.eqNullSafe(b)
    before = links.groupBy(*section).count().select(F.col("section_order").alias("_o"), F.col("line_section_id").alias("_s"), F.coalesce(F.sum("count").over(W.orderBy(*section).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    links = links.withColumn("_k", F.row_number().over(w)).join(before, key(F.col("section_order"), F.col("_o")) & key(F.col("line_section_id"), F.col("_s")))
    return links.select((F.col("_before") + F.col("_k")).cast("bigint").alias("link_id"), F.col("op_id").alias("u_node_id"), "v_node_id", "line_section_id", (F.col("to") - F.col("along")).alias("distance_m"))


def both_ways(links: DataFrame) -> DataFrame:
    """Directed edges (src, dst, link_id, direction, distance_m, line_id) of undirected links."""
    rest = ["link_id", "distance_m", *[c for c in ("line_id",) if c in links.columns]]
    there = links.select(F.col("u_node_id").alias("src"), F.col("v_node_id").alias("dst"), F.lit("uv").alias("direction"), *rest)
    return there.unionByName(links.select(F.col("v_node_id").alias("src"), F.col("u_node_id").alias("dst"), F.lit("vu").alias("direction"), *rest))


def complete_nodes(raw: DataFrame, ends: DataFrame, seen: DataFrame) -> DataFrame:
    """Nodes from the raw list, else from section ends (op_id, name, lat, lon, section_order), else placeholders for
    ids seen only in events (op_id, op_name, seq). The first source wins."""
    first = lambda df, by: df.withColumn("_r", F.row_number().over(W.partitionBy("op_id").orderBy(*by))).where("_r = 1").drop("_r")
    cols = ["op_id", "op_name", "op_type", "lat", "lon"]
    a = raw.select(*cols, F.lit(2).alias("prio"))
    b = first(ends, ["section_order"]).select("op_id", F.col("name").alias("op_name"), F.lit(None).cast("string").alias("op_type"), "lat", "lon", F.lit(1).alias("prio"))
    named = seen.where(F.trim("op_name") != "")
    c = seen.select("op_id").distinct().join(first(named, ["seq"]).select("op_id", "op_name"), "op_id", "left")
    c = c.select("op_id", "op_name", F.lit(None).cast("string").alias("op_type"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(3).alias("prio"))
    every = a.unionByName(b).unionByName(c)
    w = W.partitionBy("op_id").orderBy("prio")
    best = lambda c, by: F.first(c, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    raw_first = W.partitionBy("op_id").orderBy(F.when(F.col("prio") == 2, 0).otherwise(F.col("prio")))
    out = every.withColumns({"op_name": best("op_name", raw_first), "op_type": best("op_type", raw_first), "lat": best("lat", w), "lon": best("lon", w), "_r": F.row_number().over(w)})
    return out.where("_r = 1").select(*cols)


def unique_names(nodes: DataFrame) -> DataFrame:
    """name, name_2, name_3, ... by ascending id."""
    k = F.row_number().over(W.partitionBy("op_name").orderBy("op_id"))
    return nodes.withColumn("_k", k).withColumn("op_name", F.when(F.col("_k") == 1, F.col("op_name")).otherwise(F.concat_ws("_", "op_name", F.col("_k").cast("string")))).drop("_k")


def override_places(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """lat and lon of listed ids replaced; places(op_id, lat, lon)."""
    new = places.select("op_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    return nodes.join(new, "op_id", "left").withColumns({"lat": F.coalesce("_lat", "lat"), "lon": F.coalesce("_lon", "lon")}).drop("_lat", "_lon").select(*nodes.columns)


def biased_path(adjacency: dict, source: int, target: int, dep_line: str | None, arr_line: str | None) -> list[int] | None:
    """Link ids of the cheapest path where links on the wanted lines cost less; None if there is none.

    adjacency: node -> [(neighbour, line, metres, link)]. Ties go to the lower node, then link.
    """
    if source == target:
        return []
    wanted = {x for x in (dep_line, arr_line) if x}

    def cost(node: int, dst: int, line, metres: float) -> float:
        factor = 1.0
        if line in wanted:
            factor = ALONG
        if node == source and line in wanted:
            factor = NEAR_SAME if line == dep_line else NEAR_OTHER
        elif dst == target and line in wanted:
            factor = NEAR_SAME if line == arr_line else NEAR_OTHER
        return metres * factor

    best, back, heap = {source: 0.0}, {}, [(0.0, source, -1, -1)]
    done: set[int] = set()
    while heap:
        so_far, node, _, _ = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        if node == target:
            break
        for dst, line, metres, link in adjacency.get(node, ()):
            total = so_far + cost(node, dst, line, metres)
            if dst not in done and (total < best.get(dst, float("inf")) or (total == best.get(dst) and (node, link) < back[dst])):
                best[dst], back[dst] = total, (node, link)
                heapq.heappush(heap, (total, dst, node, link))
    if target not in back:
        return None
    path, node = [], target
    while node != source:
        node, link = back[node]
        path.append(link)
    return path[::-1]


def adjacency_of(edges: DataFrame) -> dict:
    """Adjacency lists of both_ways(links), collected; the network's size is checked first."""
    n = edges.count()
    if n > 2 * MAX_SHIPPED_LINKS:
        raise ValueError(f"{n} directed links; at most {2 * MAX_SHIPPED_LINKS} are shipped to the tasks")
    out: dict[int, list] = {}
    for r in edges.select("src", "dst", "line_id", "distance_m", "link_id").toLocalIterator():
        out.setdefault(r.src, []).append((r.dst, r.line_id, r.distance_m, r.link_id))
    for v in out.values():
        v.sort(key=lambda e: (e[0], e[3]))
    return out


def paths(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (src, dst, dep_line, arr_line) with ``path`` (NULL if unreachable): one search for each."""
    adjacency = adjacency_of(edges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            none = lambda x: None if pd.isna(x) else x
            b["path"] = [biased_path(adjacency, int(r.src), int(r.dst), none(r.dep_line), none(r.arr_line)) for r in b.itertuples()]
            yield b

    keys = ("src", "dst", "dep_line", "arr_line")
    # by a hash: the distinct rows are dealt by the keys already, and a second deal by the same keys would be left out of the plan
    return spread(requests.select(*keys).distinct(), F.xxhash64(*keys)).mapInPandas(run, "src bigint, dst bigint, dep_line string, arr_line string, path array<bigint>")


PATH_KEYS = ("src", "dst", "dep_line", "arr_line")


def fingerprint(links: DataFrame) -> str:
    """A mark of a network: another one as soon as any link is added, gone or changed; the order of rows does not count."""
    columns = sorted(set(links.columns) & {"link_id", "u_node_id", "v_node_id", "line_id", "distance_m"})
    of = lambda salt: F.sum(F.xxhash64(F.lit(salt), *columns).cast("decimal(38,0)"))
    one = links.agg(F.count("*").alias("n"), of(1).alias("a"), of(2).alias("b")).first()
    return f"{one.n}-{int(one.a or 0) % 2**64:016x}{int(one.b or 0) % 2**64:016x}"


def cached_paths(requests: DataFrame, links: DataFrame, store: str, batch: int = 0, search=paths) -> DataFrame:
    """paths(..) through a stored table of this and earlier networks: only requests that it lacks for the present network are searched, and then added.

    The table is partitioned by the network's fingerprint, so a changed network finds none of its paths there, and paths of
    others are not read. ``batch`` tells the caller by whom a path was searched. Also paths that do not exist are kept."""
    spark, mark = requests.sparkSession, fingerprint(links)
    schema = "src bigint, dst bigint, dep_line string, arr_line string, path array<bigint>, batch int, network string"

    def known() -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(store).where(F.col("network") == mark)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)

    asked = requests.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "dep_line", "arr_line").distinct()
    old = known().select(*[F.col(c).alias(f"_{c}") for c in PATH_KEYS])
    same = lambda a, b: [a(c).eqNullSafe(b(f"_{c}")) for c in PATH_KEYS]
    meet = same(F.col, F.col)
    unseen = asked.join(old, meet[0] & meet[1] & meet[2] & meet[3], "left_anti")
    if not unseen.isEmpty():
        found = search(unseen, both_ways(links)).select(*PATH_KEYS, "path", F.lit(batch).alias("batch"), F.lit(mark).alias("network"))
        found.write.mode("append").partitionBy("network").parquet(store)
    wanted = asked.select(*[F.col(c).alias(f"_{c}") for c in PATH_KEYS])
    return known().join(wanted, meet[0] & meet[1] & meet[2] & meet[3], "left_semi").drop("network")


def reachable(found: DataFrame) -> DataFrame:
    """paths(..) as it is; a path that was not found fails the run and names its ends."""
    ends = F.concat_ws(" ", F.lit("no path:"), F.col("src").cast("string"), F.lit("to"), F.col("dst").cast("string"))
    return found.withColumn("path", F.coalesce("path", F.raise_error(ends).cast("array<bigint>")))


def unordered(a, b):
    return F.least(a, b), F.greatest(a, b)


def oriented_tokens(start: int, path: list[int], ends: dict) -> list[str]:
    """``17uv`` or ``17vu`` for each link of a path from a node; a link that does not join is an error."""
    out = []
    for link in path:
        u, v = ends[link]
        if start not in (u, v):
            raise ValueError(f"link {link} ({u}, {v}) does not begin at node {start}")
        out.append(f"{link}{'uv' if start == u else 'vu'}")
        start = v if start == u else u
    return out


def spread(rows: DataFrame, *by: str | Column, at_least: int = 1) -> DataFrame:
    """rows dealt to as many tasks as the session has places for, for work in Python that is slow for its bytes: adaptive
    execution judges by bytes and would put it into one task."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism, at_least)
    return rows.repartition(n, *by)


def shipped_links(links: DataFrame) -> tuple[dict, dict]:
    """({link_id: metres}, {link_id: (u, v)}) of a network that is small enough to be shipped to the tasks."""
    if (n := links.count()) > MAX_SHIPPED_LINKS:
        raise ValueError(f"{n} links; at most {MAX_SHIPPED_LINKS} are shipped to the tasks")
    t = links.select("link_id", "u_node_id", "v_node_id", "distance_m").toPandas()
    return dict(zip(t.link_id, t.distance_m, strict=True)), dict(zip(t.link_id, zip(t.u_node_id, t.v_node_id, strict=True), strict=True))


def token_lengths(rows: DataFrame, links: DataFrame, tok: str = "tok", out: str = "metres") -> DataFrame:
    """rows with the length of their token: 0 for a blank or a stop, a link's metres; any other token is an error."""
    way, still = F.col(tok).rlike("^[0-9]+(uv|vu)$"), F.coalesce(F.col(tok), F.lit("")).rlike("^$|^STOPPED@")
    link = F.when(way, F.expr(f"try_cast(left({tok}, length({tok}) - 2) as bigint)"))
    joined = rows.withColumn("_link", link).join(links.select(F.col("link_id").alias("_id"), F.col("distance_m").alias("_m")), F.col("_link") == F.col("_id"), "left")
    wrong = F.raise_error(F.concat(F.lit("no length for token "), F.col(tok))).cast("double")
    return joined.withColumn(out, F.when(still, F.lit(0.0)).when(F.col("_m").isNotNull(), F.col("_m")).otherwise(wrong)).drop("_link", "_id", "_m")


def path_tokens(found: DataFrame, links: DataFrame) -> DataFrame:
    """paths(src, dst, dep_line, arr_line, path) with ``toks``, ``17uv`` or ``17vu`` for each link of the path, and ``along``, the metres up to the end of each.

    A link that does not join the one before is an error."""
    keys = ["src", "dst", "dep_line", "arr_line"]
    steps = found.select(*keys, F.posexplode_outer("path").alias("pos", "link_id")).join(links.select("link_id", "u_node_id", "v_node_id", "distance_m"), "link_id", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("link_id").isNotNull(), F.struct("pos", "link_id", "u_node_id", "v_node_id", "distance_m"))))
    steps = steps.groupBy(*keys).agg(ordered.alias("steps")).withColumn("src", F.col("src").cast("bigint"))
    wrong = lambda node, x: F.raise_error(F.concat_ws(" ", F.lit("link"), x["link_id"].cast("string"), F.lit("does not begin at node"), node.cast("string"))).cast("bigint")
    ahead_of = lambda node, x: F.when(x["u_node_id"] == node, x["v_node_id"]).when(x["v_node_id"] == node, x["u_node_id"]).otherwise(wrong(node, x))

    def step(so_far, x):
        way = F.concat(x["link_id"].cast("string"), F.when(x["u_node_id"] == so_far["node"], "uv").otherwise("vu"))
        metres = so_far["metres"] + x["distance_m"]
        return F.struct(ahead_of(so_far["node"], x).cast("bigint").alias("node"), metres.alias("metres"), F.concat(so_far["toks"], F.array(way)).alias("toks"), F.concat(so_far["along"], F.array(metres)).alias("along"))

    start = F.struct(F.col("src").alias("node"), F.lit(0.0).alias("metres"), F.array().cast("array<string>").alias("toks"), F.array().cast("array<double>").alias("along"))
    known = steps.withColumn("t", F.aggregate("steps", start, step))
    return known.select(*keys, F.transform("steps", lambda x: x["link_id"]).alias("path"), "t.toks", "t.along")


def journey_hops(transitions: DataFrame, tokens: DataFrame, keys=("train_id", "service_date")) -> DataFrame:
    """transitions(keys, pos, op_id, to_op_id, dep_line, arr_line, planned_ts, to_planned_ts) with path_tokens -> one row for each journey: ``hops``, in order.

    A hop without links is a stop: its one token names the station and the next link the train will take."""
    tokens = tokens.select(*[F.col(c).alias(f"_{c}") for c in ("src", "dst", "dep_line", "arr_line")], "path", "toks", "along")
    on = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("op_id", "_src"), ("to_op_id", "_dst"), ("dep_line", "_dep_line"), ("arr_line", "_arr_line"))]
    planned = (micros(F.col("to_planned_ts")) - micros(F.col("planned_ts"))) / 1e6
    hop = F.struct(F.col("pos").cast("int").alias("pos"), "op_id", "toks", "along", micros(F.col("planned_ts")).alias("planned_us"), planned.alias("planned_sec"), F.get("path", F.lit(0)).alias("first"))
    rows = transitions.join(tokens, on[0] & on[1] & on[2] & on[3]).select(*keys, hop.alias("hop"))
    rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("hop")).alias("h"))

    def named(x):
        coming = F.get(F.filter("h", lambda y: (y["pos"] > x["pos"]) & y["first"].isNotNull()), F.lit(0))["first"]
        stop = F.concat(F.lit("STOPPED@op"), x["op_id"].cast("string"), F.lit("to"), F.coalesce(coming.cast("string"), F.lit("END")))
        return F.struct(x["pos"].alias("pos"), F.when(F.size(x["toks"]) > 0, x["toks"]).otherwise(F.array(stop)).alias("toks"), x["along"].alias("along"), x["planned_us"].alias("planned_us"), x["planned_sec"].alias("planned_sec"))

    return rows.select(*keys, F.transform("h", named).alias("hops"))


def with_tokens(active: DataFrame, size: int, past: int, snapshot: str = "snapshot_ts") -> DataFrame:
    """active(.., hops, split_idx, snapshot, last_known_delay) with ``tokens``: the one a train is on and those ahead, ``size`` in all, '' as padding.

    On the hop under way, time is spread over the links by their length; links that lie behind are left out."""
    event = F.col("split_idx") - past - 1

    def part(h):
        passed = F.greatest(F.lit(0.0), micros(F.col(snapshot)) / 1e6 - (h["planned_us"] / 1e6 + F.col("last_known_delay")))
        behind = F.size(F.filter(h["along"], lambda m: h["planned_sec"] * m / F.element_at(h["along"], -1) < passed))
        skip = F.when((h["pos"] == event) & (F.size(h["toks"]) > 1), F.least(F.size(h["toks"]) - 1, behind)).otherwise(0)
        return F.slice(h["toks"], skip + 1, F.size(h["toks"]))

    parts = F.flatten(F.transform(F.filter("hops", lambda h: h["pos"] >= event), part))
    none = F.array().cast("array<string>")
    found = F.concat(F.when((event < 0) & F.col("hops").isNotNull(), F.array(F.lit(""))).otherwise(none), F.coalesce(parts, none))
    return active.withColumn("tokens", F.slice(F.concat(found, F.array_repeat(F.lit(""), size)), 1, size))


def ahead(rows: DataFrame, snapshot: str = "snapshot_ts") -> DataFrame:
    """rows(snapshot, journey_ord, tokens, planned_1, last_known_delay) with the token they are on (tok0), the trains
    before them on it and their mean delay."""
    cur = rows.withColumn("tok0", F.col("tokens")[0])
    w = W.partitionBy(snapshot, "tok0").orderBy("planned_1", "journey_ord")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    on = F.col("tok0") != ""
    n = F.when(on, F.row_number().over(w) - 1).otherwise(0).cast("bigint")
    return cur.withColumns({"n_ahead": n, "mean_ahead": F.when(on, F.avg("last_known_delay").over(before))})


def crowding(rows: DataFrame, snapshot: str = "snapshot_ts") -> DataFrame:
    """rows as ``ahead`` takes them with, for each link slot, the trains that matter and their mean delay: slot 0 those
    ahead on the same token, later slots all that are now on that token."""
    cur = ahead(rows, snapshot)
    stats = cur.where("tok0 <> ''").groupBy(snapshot, F.col("tok0").alias("tok")).agg(F.count("*").alias("n_on"), F.avg("last_known_delay").alias("mean_on"))
    slots = cur.select(snapshot, "journey_ord", "n_ahead", "mean_ahead", F.posexplode("tokens").alias("link_slot", "tok")).join(stats, [snapshot, "tok"], "left")
    first = F.col("link_slot") == 0
    return slots.select(snapshot, "journey_ord", "link_slot", "tok", F.when(first, F.col("n_ahead")).otherwise(F.coalesce("n_on", F.lit(0))).cast("bigint").alias("n_trains"), F.when(first, F.col("mean_ahead")).otherwise(F.col("mean_on")).alias("mean_delay"))
