"""Composite builders: snapshot sampling, tabular rows, graph tables, simulation, boosted trees, result tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import boosted, clean, evaluate, features, geometry, graphs, intervals, journeys, network, simulate, snapshots
from ..sources import scratch
from . import adapter as A
from .network_queries import TO_TOKENS, deduced, tokens
from .registry import query
from .snapshot_queries import BASE, KEY, active, activity, bins_sql, naive, split, targets, truth

SEED = 42


def sampled(spark, sf, n_train=40, n_test=10):
    """The core dataset's snapshots: seeded active seconds of the train days, then of the test days after the last
    journey of the train days has ended, and a minute more."""
    import numpy as np

    act, rng = activity(spark, sf), np.random.default_rng(SEED)
    us = lambda text: int(np.datetime64(text, "us").astype(int))
    tail = act.where("service_date = '2024-01-19'").agg(F.max(S.micros(F.col("end_observed_ts")))).first()[0]
    train = intervals.sample_active_seconds(act, us("2024-01-02"), us("2024-01-20"), n_train, rng)
    test = intervals.sample_active_seconds(act, max(us("2024-01-21"), (tail or 0) + 6 * 60_000_000), us("2024-01-29"), n_test, rng)
    rows = [(s, "train") for s in train] + [(s, "test") for s in test]
    return spark.createDataFrame(rows, "s bigint, split string").select(S.from_micros(F.col("s") * 1_000_000).alias("snapshot_ts"), "split")


@query("n02_sampled_snapshots")
def sampled_snapshots(spark, sf):
    return sampled(spark, sf)


@query("n05_core_dataset")
def core_dataset(spark, sf):
    pairs = intervals.join_active(activity(spark, sf), sampled(spark, sf)).select(*KEY, "snapshot_ts", "split")
    arrays = snapshots.padded(journeys.event_arrays(A.events(spark, sf)), 1, 3, 5, 5)
    s = snapshots.with_last_delay(snapshots.split_at(pairs.join(arrays, KEY), 1, 3))
    long = snapshots.long_targets(s, ["snapshot_ts", *KEY, "split", "last_known_delay"])
    return snapshots.wide_targets(long, ["snapshot_ts", *KEY, "split", "last_known_delay"], 3)


def tabular(spark, sf):
    """Raw tabular rows with engineered columns: slots, crowding on the current token, time, relation."""
    s = network.ahead(tokens(spark, sf, past=3, future=3, keep=("split", "past_slots", "future_slots", "relation")))
    rows = s.withColumn("relation_type", S.relation_type(F.col("relation")))
    slot = lambda c, k: F.col(c)[k]["delay_sec"]
    cols = [slot("past_slots", k).alias(f"past_delay_sec_{k + 1}") for k in range(3)]
    target = [S.signed_sqrt(F.when(F.col("future_slots")[k]["op_id"] != -1, slot("future_slots", k)) - F.col("last_known_delay")).alias(f"y_{k + 1}") for k in range(3)]
    when = S.cyclic(S.day_fraction(F.col("snapshot_ts")), "snapshot_hour", (1,))
    return rows.select(*KEY, "snapshot_ts", "split", "last_known_delay", *cols, F.col("n_ahead").cast("double").alias("link_n_ahead"), F.coalesce("mean_ahead", F.lit(0.0)).alias("link_mean_ahead"), *when, *S.indicators(F.col("relation_type"), ("IC", "L", "S", "P", "EXTRA"), "train_relation"), *target)


ROOT = lambda k: f"sign(t{k}.future_delay - r.last_known_delay) * sqrt(abs(t{k}.future_delay - r.last_known_delay)) AS y_{k}"
SLOT = lambda table, name, k: f"LEFT JOIN (SELECT * FROM {table} WHERE slot = {k}) {name}{k} ON {name}{k}.train_id = r.train_id AND {name}{k}.service_date = r.service_date AND {name}{k}.snapshot_ts = r.snapshot_ts"
ROWS = f"""raw AS (SELECT r.train_id, r.service_date, r.snapshot_ts, r.split, r.last_known_delay, {", ".join(f"coalesce(p{k}.delay_sec, 0)::DOUBLE AS past_delay_sec_{k}" for k in (1, 2, 3))},
  n_ahead::DOUBLE AS link_n_ahead, coalesce(mean_ahead, 0) AS link_mean_ahead, {", ".join(ROOT(k) for k in (1, 2, 3))}
  FROM first_tok r {" ".join(SLOT("pst", "p", k) + " " + SLOT("tgt", "t", k) for k in (1, 2, 3))})"""
Z = ("last_known_delay", "past_delay_sec_1", "link_n_ahead", "link_mean_ahead", "y_1")
RAW = ("last_known_delay", *[f"past_delay_sec_{k}" for k in (1, 2, 3)], "link_n_ahead", "link_mean_ahead", *[f"y_{k}" for k in (1, 2, 3)])
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in RAW)


@query("n06_tabular_rows", A.with_ctes(*TO_TOKENS, ROWS, tail=f"SELECT train_id, service_date, snapshot_ts, split, {ROUNDED} FROM raw"))
def tabular_rows(spark, sf):
    return tabular(spark, sf).select(*KEY, "snapshot_ts", "split", *[F.round(c, 6).alias(c) for c in RAW])


SCALED = ", ".join(f"round((raw.{c} - {c}_m) / {c}_d, 5) + 0.0::DOUBLE AS {c}" for c in Z)
LEARNED = "m AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_d" for c in Z) + " FROM raw WHERE split = 'train')"


@query("n08_normalised_rows", A.with_ctes(*TO_TOKENS, ROWS, LEARNED, tail=f"SELECT train_id, service_date, snapshot_ts, split, {SCALED} FROM raw, m"))
def normalised_rows(spark, sf):
    """Every row, scaled by what the train rows say: two passes over the table, one for the numbers."""
    t = tabular(spark, sf).select(*KEY, "snapshot_ts", "split", *Z)
    out = features.normalise(t, features.moments(t, list(Z)), z=list(Z))
    return out.select(*KEY, "snapshot_ts", "split", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in Z])


POOL = "m AS (SELECT avg(x) AS mean, stddev_samp(x) AS std FROM (SELECT unnest([past_delay_sec_1, past_delay_sec_2, past_delay_sec_3]) AS x FROM raw WHERE split = 'train'))"
STEPS = ", ".join(f"round((past_delay_sec_{k} - mean) / std, 5) + 0.0::DOUBLE AS step_{4 - k}" for k in (3, 2, 1))


@query("n09_sequences", A.with_ctes(*TO_TOKENS, ROWS, POOL, tail=f"SELECT train_id, service_date, snapshot_ts, split, {STEPS} FROM raw, m"))
def sequences(spark, sf):
    """The past as steps, oldest first, scaled by one set of numbers."""
    past = [f"past_delay_sec_{k}" for k in (3, 2, 1)]
    t = tabular(spark, sf).select(*KEY, "snapshot_ts", "split", *past)
    p = features.pooled(t, {"past": past}).select("mean", "std")
    steps = [(F.round(S.z_score(F.col(c), F.col("mean"), F.col("std")), 5) + F.lit(0.0)).alias(f"step_{k + 1}") for k, c in enumerate(past)]
    return t.crossJoin(F.broadcast(p)).select(*KEY, "snapshot_ts", "split", *steps)  # one row


NODE = "w AS (SELECT *, row_number() OVER (PARTITION BY snapshot_ts ORDER BY service_date, train_id) - 1 AS node FROM lkd)"


@query("n10_train_nodes", A.with_ctes(*BASE, NODE, tail="SELECT snapshot_ts, node, train_id, service_date, split, last_known_delay FROM w"))
def train_nodes(spark, sf):
    return _nodes(spark, sf).select("snapshot_ts", "node", *KEY, "split", "last_known_delay")


def _nodes(spark, sf):
    w = W.partitionBy("snapshot_ts").orderBy("service_date", "train_id")
    return split(spark, sf).withColumn("node", (F.row_number().over(w) - 1).cast("bigint"))


@query("n11_station_nodes", A.with_ctes(*BASE, A.NODES, "c AS (SELECT snapshot_ts, op_id, count(*) AS n FROM pst WHERE slot = 1 GROUP BY 1, 2)", tail="SELECT snapshot_ts, op_id, coalesce(n, 0) AS n_last_seen FROM snap CROSS JOIN nodes LEFT JOIN c USING (snapshot_ts, op_id)"))
def station_nodes(spark, sf):
    last = split(spark, sf, 1, 1).select("snapshot_ts", F.col("past_slots")[0]["op_id"].alias("op_id")).groupBy("snapshot_ts", "op_id").agg(F.count("*").alias("n"))
    grid = A.snapshots(spark).select("snapshot_ts").crossJoin(A.nodes(spark, sf).select("op_id"))  # a dense grid is the feature
    return grid.join(last, ["snapshot_ts", "op_id"], "left").select("snapshot_ts", "op_id", F.coalesce("n", F.lit(0)).alias("n_last_seen"))


TRAFFIC = "t AS (SELECT snapshot_ts, tok, n_on, mean_on FROM on_link)"
WAY = lambda w: f"LEFT JOIN t {w} ON {w}.snapshot_ts = snap.snapshot_ts AND {w}.tok = links.link_id || '{w}'"


@query("n12_link_traffic", A.with_ctes(*TO_TOKENS, TRAFFIC, tail=f"SELECT snap.snapshot_ts, link_id, coalesce(uv.n_on, 0) AS uv_trains, coalesce(vu.n_on, 0) AS vu_trains, round(uv.mean_on, 6) AS uv_delay, round(vu.mean_on, 6) AS vu_delay FROM snap CROSS JOIN links {WAY('uv')} {WAY('vu')}"))
def link_traffic(spark, sf):
    on = tokens(spark, sf).select("snapshot_ts", F.col("tokens")[0].alias("tok"), "last_known_delay").where(F.col("tok").rlike("^[0-9]+(uv|vu)$"))
    on = on.withColumns({"link_id": F.regexp_extract("tok", "^([0-9]+)", 1).cast("bigint"), "way": F.regexp_extract("tok", "(uv|vu)$", 1)})
    agg = on.groupBy("snapshot_ts", "link_id").agg(*[x for w in ("uv", "vu") for x in (F.count_if(F.col("way") == w).alias(f"{w}_trains"), F.avg(F.when(F.col("way") == w, F.col("last_known_delay"))).alias(f"{w}_delay"))])
    grid = A.snapshots(spark).select("snapshot_ts").crossJoin(A.links(spark, sf).select("link_id"))  # a dense grid is the feature
    return grid.join(agg, ["snapshot_ts", "link_id"], "left").select("snapshot_ts", "link_id", *[F.coalesce(f"{w}_trains", F.lit(0)).alias(f"{w}_trains") for w in ("uv", "vu")], *[F.round(f"{w}_delay", 6).alias(f"{w}_delay") for w in ("uv", "vu")])


@query("n13_future_edges", A.with_ctes(*BASE, NODE, tail="SELECT t.snapshot_ts, node, slot, future_op_id, future_delay FROM tgt t JOIN w USING (train_id, service_date, snapshot_ts)"))
def future_edges(spark, sf):
    n = _nodes(spark, sf).select("snapshot_ts", "node", F.posexplode("future_slots").alias("p", "e")).where("e.op_id <> -1")
    return n.select("snapshot_ts", "node", (F.col("p") + 1).cast("bigint").alias("slot"), F.col("e.op_id").alias("future_op_id"), F.col("e.delay_sec").alias("future_delay"))


@query("w09_past_edges", A.with_ctes(*BASE, NODE, tail="SELECT p.snapshot_ts, node, slot, op_id, delay_sec::DOUBLE AS delay_sec FROM pst p JOIN w USING (train_id, service_date, snapshot_ts) WHERE slot <= 3"))
def past_edges(spark, sf):
    n = _nodes(spark, sf).select("snapshot_ts", "node", F.posexplode("past_slots").alias("p", "e")).where("e.op_id <> -1")
    return n.select("snapshot_ts", "node", (F.col("p") + 1).cast("bigint").alias("slot"), "e.op_id", "e.delay_sec")


GRAPH = """nd AS (SELECT snapshot_ts, string_agg(node || ':' || train_id, ',' ORDER BY node) AS trains FROM w GROUP BY 1),
ed AS (SELECT snapshot_ts, string_agg(node || ':' || slot || ':' || future_op_id, ',' ORDER BY node, slot) AS ahead, string_agg(future_op_id || ':' || slot || ':' || node, ',' ORDER BY node, slot) AS reverse FROM tgt JOIN w USING (train_id, service_date, snapshot_ts) GROUP BY 1)"""


@query("n14_graph_rows", A.with_ctes(*BASE, NODE, GRAPH, tail="SELECT snapshot_ts, trains, coalesce(ahead, '') AS ahead, coalesce(reverse, '') AS reverse FROM nd LEFT JOIN ed USING (snapshot_ts)"))
def graph_rows(spark, sf):
    """One row for each snapshot: its train nodes and its edges to stations, both ways, written out as text."""
    nodes = _nodes(spark, sf).groupBy("snapshot_ts").agg(F.array_sort(F.collect_list(F.struct("node", "train_id"))).alias("trains"))
    edges = future_edges(spark, sf).groupBy("snapshot_ts").agg(F.array_sort(F.collect_list(F.struct("node", "slot", "future_op_id"))).alias("ahead"))
    g = nodes.join(edges, "snapshot_ts", "left")
    listed = lambda c, *names: F.coalesce(F.array_join(F.transform(c, lambda e: F.concat_ws(":", *[e[n].cast("string") for n in names])), ","), F.lit(""))
    edge = ("node", "slot", "future_op_id")
    return g.select("snapshot_ts", listed("trains", "node", "train_id").alias("trains"), listed("ahead", *edge).alias("ahead"), listed("ahead", *edge[::-1]).alias("reverse"))


def travel_stats(spark, sf):
    """Travel-time rows by transition type, from the journeys active at train snapshots."""
    seen = active(spark, sf).where("split = 'train'").select(*KEY).distinct()
    t = journeys.transitions(A.events(spark, sf).join(seen, KEY, "left_semi"))
    sec = (S.micros(F.col("to_observed_ts")) - S.micros(F.col("observed_ts"))) / 1e6
    line = F.lit("L").alias("line")
    t = t.select(F.col("op_id").alias("from_op_id"), F.col("event_type").alias("from_event_type"), line.alias("from_dep_line"), "to_op_id", "to_event_type", line.alias("to_arr_line"), "train_relation", sec.alias("sec"))
    keys = [c for c in t.columns if c != "sec"]
    q = F.percentile("sec", F.array(F.lit(0.4), F.lit(0.45), F.lit(0.5)))
    return t.groupBy(*keys).agg(q.alias("q"), F.count("*").alias("n")).select(*keys, "n", *[F.col("q")[k].alias(n) for k, n in enumerate(("q40", "q45", "median"))])


@query("n15_travel_stats", A.with_ctes(*BASE[:4], "seen AS (SELECT DISTINCT train_id, service_date FROM active WHERE split = 'train'), tt AS (SELECT op_id, event_type, train_relation, lead(op_id) OVER w AS to_op_id, lead(event_type) OVER w AS to_event_type, (epoch_us(lead(observed_ts) OVER w) - epoch_us(observed_ts)) / 1e6 AS sec FROM ev SEMI JOIN seen USING (train_id, service_date) WINDOW w AS (PARTITION BY train_id, service_date ORDER BY observed_ts, planned_ts, seq))", tail="SELECT op_id AS from_op_id, to_op_id, event_type AS from_event_type, to_event_type, train_relation, count(*) AS n, round(quantile_cont(sec, 0.4), 8) AS q40, round(quantile_cont(sec, 0.5), 8) AS median FROM tt WHERE to_op_id IS NOT NULL GROUP BY ALL"))
def travel_stats_rows(spark, sf):
    return travel_stats(spark, sf).select("from_op_id", "to_op_id", "from_event_type", "to_event_type", "train_relation", "n", F.round("q40", 8).alias("q40"), F.round("median", 8).alias("median"))


def sim_journeys(spark, sf):
    """Journeys with their events, planned times that run backward held at the latest so far; one scan of the events, kept as a table."""
    held = clean.with_streaks(A.events(spark, sf), "planned_ts", "held_ts", "streak")
    return scratch.stored(graphs.journey_arrays(held, also=("held_ts", "streak")), "journeys")


def sim_input(spark, sf, day="2024-01-10", arrays=None, links=None):
    """Active journeys of one day's snapshots with their events in path order and their paths. arrays, links: ``sim_journeys`` and the network, where they are there already."""
    arrays = sim_journeys(spark, sf) if arrays is None else arrays
    inside = F.array_min("events.streak") >= -(10**9) * 1_000_000
    e = F.array_sort(F.transform("events", lambda x: F.struct(x["observed_ts"].alias("observed_ts"), x["held_ts"].alias("planned_ts"), x["seq"].alias("seq"), x["op_id"].alias("op_id"), x["event_type"].alias("event_type"))))
    ev = F.transform(e, lambda x: F.struct(x["op_id"].alias("op_id"), x["event_type"].alias("event_type"), F.lit("L").alias("line_dep"), F.lit("L").alias("line_arr"), F.floor(S.micros(x["planned_ts"]) / 1_000_000).alias("planned_s")))
    pairs = split(spark, sf, 1, 1, arrays.where(inside).withColumn("way", ev), ("relation", "way")).select(*KEY, "snapshot_ts", "relation", "last_known_delay", (F.col("split_idx") - 2).alias("event_idx"), "way")
    rows = pairs.where(F.to_date("snapshot_ts") == day) if day else pairs
    paths = deduced(spark, sf, graphs.transitions_of(arrays), links)
    return rows.join(paths, KEY, "left").select("snapshot_ts", *KEY, F.col("relation").alias("train_relation"), "event_idx", "last_known_delay", F.col("deduced_paths").alias("path"), F.col("way").alias("events"))


@query("e07_simulated_delays")
def simulated(spark, sf):
    links = scratch.stored(A.links(spark, sf), "links")
    out = simulate.simulate(sim_input(spark, sf, None, links=links), links, travel_stats(spark, sf))
    return out.select("snapshot_ts", *KEY, F.size("predictions").alias("n_predicted"), F.get("predictions", F.lit(0)).alias("first_delay"))


@query("e09_simulated_table")
def simulated_table(spark, sf):
    arrays, links = sim_journeys(spark, sf), scratch.stored(A.links(spark, sf), "links")
    out = simulate.simulate(sim_input(spark, sf, None, arrays, links), links)
    return simulate.prediction_table(active(spark, sf, arrays), out, 3)


@query("e08_expected_seconds", A.with_ctes(A.EV, tail="SELECT seq, greatest(coalesce(CASE WHEN op_id % 3 = 0 THEN op_id::DOUBLE END, CASE WHEN op_id % 5 = 0 THEN op_id * 2.0::DOUBLE END, 60.0::DOUBLE), 60.0::DOUBLE - delay_sec) AS sec FROM (SELECT *, CASE WHEN op_id = 0 THEN NULL ELSE op_id END AS o FROM ev) WHERE op_id <> 0"))
def expected_seconds(spark, sf):
    o = F.col("op_id").cast("double")
    e = A.events(spark, sf).where("op_id <> 0")
    return e.select("seq", simulate.expected_seconds(F.lit(60.0), F.col("delay_sec"), F.when(F.col("op_id") % 3 == 0, o), F.when(F.col("op_id") % 5 == 0, o * 2.0), F.lit(None).cast("double")).alias("sec"))


SCORES = "count(*) AS n_values, round(avg(abs(last_known_delay - future_delay)), 6) AS mae, round(sqrt(avg((last_known_delay - future_delay) ** 2)), 6) AS rmse FROM tgt"
BY_HORIZON = bins_sql("(epoch_us(future_obs_ts) - epoch_us(snapshot_ts)) / 1e6 / 60", evaluate.HORIZON_MIN, "m")
BY_CHANGE = bins_sql("(future_delay - last_known_delay)", evaluate.CHANGE_SEC, "s")


@query("e05_full_evaluation", A.with_ctes(*BASE, tail=f"SELECT 'all' AS part, {SCORES} UNION ALL SELECT 'horizon:' || {BY_HORIZON}, {SCORES} GROUP BY 1 UNION ALL SELECT 'change:' || {BY_CHANGE}, {SCORES} GROUP BY 1"))
def full_evaluation(spark, sf):
    table = scratch.stored(truth(spark, sf), "truth")
    r = evaluate.evaluate(table, naive(spark, sf, table))
    flat = [("all", r["mae"], r["rmse"], r["n_values"])] + [(f"{g}:{b}", m["mae"], m["rmse"], m["n_values"]) for g in ("horizon", "change") for b, m in r[g].items()]
    out = spark.createDataFrame(flat, "part string, mae double, rmse double, n_values bigint")
    return out.select("part", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), "n_values")


HORIZONS = ("y_1", "y_2", "y_3")


def _learnable(spark, sf):
    """(rows, train rows, test rows, feature columns) of the tabular rows, kept while models are trained."""
    t = tabular(spark, sf).drop(*KEY, "snapshot_ts").persist()
    names = [c for c in t.columns if c not in ("split", *HORIZONS)]
    return t, t.where("split = 'train'"), t.where("split = 'test'"), names


@query("e11_boosted_trees")
def boosted_trees(spark, sf):
    """A model for each horizon, rows without a target masked; returns their errors in seconds on the test split."""
    t, train, test, names = _learnable(spark, sf)
    rows = [(k + 1, *boosted.errors(boosted.fit(train, names, y, seed=SEED), test, y, S.signed_square).first()) for k, y in enumerate(HORIZONS)]
    t.unpersist()
    return spark.createDataFrame(rows, "horizon int, n long, mae double").withColumn("mae", F.round("mae", 3))


@query("e16_validation_mae", A.with_ctes(*BASE, tail="SELECT split, round(avg(abs(last_known_delay - future_delay)), 6) AS mae FROM tgt WHERE slot = 1 GROUP BY 1"))
def validation_mae(spark, sf):
    t = targets(spark, sf).where("slot = 1 and future_delay is not null")
    return t.groupBy("split").agg(F.round(F.avg(F.abs(F.col("last_known_delay") - F.col("future_delay"))), 6).alias("mae"))


@query("e19_family_columns")
def family_columns(spark, sf):
    """The first horizon trained anew without each feature family, against all of them."""
    t, train, test, names = _learnable(spark, sf)
    rows = boosted.ablation(train, test, names, HORIZONS[0], ("last_known_delay",), S.signed_square, seed=SEED)
    t.unpersist()
    out = spark.createDataFrame(rows, "family string, n_columns int, mae double, change double")
    return out.select("family", "n_columns", F.round("mae", 3).alias("mae"), F.round("change", 3).alias("change"))


@query("a17_seed_summary", "SELECT model, round(avg(mae), 6) AS mean_mae, round(stddev_pop(mae), 6) AS std_mae FROM (SELECT l_returnflag AS model, l_linenumber AS seed, (sum(l_quantity::BIGINT) % 100)::DOUBLE AS mae FROM lineitem GROUP BY 1, 2) GROUP BY model")
def seed_summary(spark, sf):
    from ..session import table

    runs = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("seed")).agg((F.sum(F.col("l_quantity").cast("bigint")) % 100).cast("double").alias("mae"))
    return runs.groupBy("model").agg(F.round(F.avg("mae"), 6).alias("mean_mae"), F.round(F.stddev_pop("mae"), 6).alias("std_mae"))


@query("e20_best_marked", "SELECT model, seed, mae, mae = min(mae) OVER (PARTITION BY seed) AS best FROM (SELECT l_returnflag AS model, l_linenumber AS seed, sum(l_quantity::BIGINT)::BIGINT AS mae FROM lineitem GROUP BY 1, 2)")
def best_marked(spark, sf):
    from ..session import table

    runs = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("seed")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("mae"))
    return runs.withColumn("best", F.col("mae") == F.min("mae").over(W.partitionBy("seed")))


@query("d07_section_matches", A.with_ctes(A.NODES, "s AS (SELECT op_id // 10 AS section, count(*) FILTER (WHERE op_id % 10 IN (0, 3, 4, 9)) AS matched FROM nodes GROUP BY 1)", tail="SELECT matched, count(*) AS n FROM s GROUP BY 1"))
def section_matches(spark, sf):
    s = A.nodes(spark, sf).groupBy(F.floor(F.col("op_id") / 10).alias("section")).agg(F.count_if((F.col("op_id") % 10).isin(0, 3, 4, 9)).alias("matched"))
    return s.groupBy("matched").agg(F.count("*").alias("n"))


@query("d18_weather_at_nodes", A.with_ctes(A.WX, A.NODES, "one AS (SELECT time FROM wx WHERE seq = 1 ORDER BY abs(epoch_us(time) - epoch_us(TIMESTAMP '2024-01-12 06:40:00')), time LIMIT 1)", tail="SELECT n.op_id, op_name, temperature_2m FROM wx SEMI JOIN one USING (time) JOIN nodes n ON n.op_id = wx.op_id WHERE seq = 1"))
def weather_at_nodes(spark, sf):
    w = A.raw_weather(spark, sf).where("seq = 1")
    want = S.micros(F.lit("2024-01-12 06:40:00").cast("timestamp_ntz"))
    one = w.select("time").orderBy(F.abs(S.micros(F.col("time")) - want), "time").limit(1)
    return w.join(F.broadcast(one), "time", "left_semi").join(A.nodes(spark, sf), "op_id").select("op_id", "op_name", "temperature_2m")


@query("d25_train_station_edge", A.with_ctes(*BASE, tail="SELECT snapshot_ts, train_id, service_date, op_id FROM pst WHERE slot = 1"))
def train_station_edge(spark, sf):
    s = split(spark, sf, 1, 1).select("snapshot_ts", *KEY, F.col("past_slots")[0]["op_id"].alias("op_id"))
    return s.where("op_id <> -1")


@query("d27_embedding_places")
def embedding_places(spark, sf):
    emb = geometry.laplacian_embedding(geometry.shipped_edges(A.links(spark, sf)))
    e = spark.createDataFrame(list(emb.items()), "op_id bigint, embedding array<double>")
    return A.nodes(spark, sf).join(e, "op_id", "left").select("op_id", "lat", "lon", F.coalesce(F.size("embedding"), F.lit(0)).alias("dim"))
