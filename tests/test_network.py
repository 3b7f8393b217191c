"""Paths, tokens, crowding, geometry, simulation: hand cases and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import geometry, network, simulate


def adjacency(links):
    out = {}
    for k, (u, v, line, m) in enumerate(links, 1):
        out.setdefault(u, []).append((v, line, m, k))
        out.setdefault(v, []).append((u, line, m, k))
    return out


def test_preferred_line_wins():
    a = adjacency([(1, 2, "x", 100.0), (1, 2, "dep", 120.0)])
    assert network.biased_path(a, 1, 2, None, None) == [1]
    assert network.biased_path(a, 1, 2, "dep", None) == [2]
    assert network.biased_path(a, 1, 1, None, None) == [] and network.biased_path(a, 1, 9, None, None) is None


@pytest.mark.parametrize("seed", range(15))
def test_paths_are_cheapest(seed):
    """Against all simple paths of a small graph."""
    r = random.Random(seed)
    links = [(u, v, r.choice("ab"), float(r.randrange(1, 50))) for u, v in itertools.combinations(range(6), 2) if r.random() < 0.6]
    a = adjacency(links)
    dep, arr = r.choice(["a", "b", None]), r.choice(["a", "b", None])

    def cost(path, s, t):
        node, total, wanted = s, 0.0, {dep, arr} - {None}
        for k in path:
            u, v, line, m = links[k - 1]
            nxt = v if node == u else u
            f = 1.0
            if line in wanted:
                f = 0.65
                if node == s:
                    f = 0.55 if line == dep else 0.75
                elif nxt == t:
                    f = 0.55 if line == arr else 0.75
            total, node = total + m * f, nxt
        return total

    def simple(node, t, seen, path):
        if node == t:
            yield path
            return
        for nxt, _, _, k in a.get(node, ()):
            if nxt not in seen:
                yield from simple(nxt, t, seen | {nxt}, [*path, k])

    for s, t in itertools.permutations(range(6), 2):
        every = [cost(p, s, t) for p in simple(s, t, {s}, [])]
        got = network.biased_path(a, s, t, dep, arr)
        assert (got is None) == (not every)
        if every:
            assert cost(got, s, t) == pytest.approx(min(every))


def test_paths_on_spark(spark):
    links = spark.createDataFrame([(1, 1, 2, "x", 5.0), (2, 2, 3, "y", 5.0)], "link_id long, u_node_id long, v_node_id long, line_id string, distance_m double")
    req = spark.createDataFrame([(1, 3, None, None), (3, 1, "x", None), (1, 9, None, None)], "src long, dst long, dep_line string, arr_line string")
    got = {(r.src, r.dst): r.path for r in network.paths(req, network.both_ways(links)).collect()}
    assert got == {(1, 3): [1, 2], (3, 1): [2, 1], (1, 9): None}


def test_path_searches_are_dealt_to_all_places(spark):
    """Small requests would else meet in one task."""
    links = spark.range(1, 30).selectExpr("id AS link_id", "id AS u_node_id", "id + 1 AS v_node_id", "'x' AS line_id", "5D AS distance_m")
    req = spark.createDataFrame([(a, b, "x", "x") for a in range(1, 30) for b in range(1, 30)], "src long, dst long, dep_line string, arr_line string")
    found = network.paths(req, network.both_ways(links)).withColumn("task", F.spark_partition_id()).collect()
    assert len(found) == 29 * 29 and len({r.task for r in found}) >= spark.sparkContext.defaultParallelism


def window_by_hand(path, ops, plan, event, now, delay, size, lengths, ends):
    """The tokens of one journey, link by link."""
    ahead = lambda t: next((str(x[0]) for x in path[t:] if x), "END")
    out = [""] if event < 0 else []
    for t in range(max(event, 0), len(path)):
        toks = network.oriented_tokens(ops[t], path[t], ends) if path[t] else [f"STOPPED@op{ops[t]}to{ahead(t + 1)}"]
        if t == event and len(toks) > 1:
            total, along, skip = sum(lengths[x] for x in path[t]), 0.0, 0
            for x in path[t][:-1]:
                along += lengths[x]
                skip += (plan[t + 1] - plan[t]) * along / total < max(0.0, now - plan[t] - delay)
            toks = toks[skip:]
        out += toks
    return (out + [""] * size)[:size]


def test_tokens(spark):
    rows = [(1, 10, 11, "x", 100.0), (2, 12, 11, "x", 300.0), (3, 12, 13, "y", 50.0), (4, 13, 14, "y", 70.0), (5, 14, 10, "x", 9000.0)]
    links = spark.createDataFrame(rows, "link_id long, u_node_id long, v_node_id long, line_id string, distance_m double")
    ends, lengths = {r[0]: r[1:3] for r in rows}, {r[0]: r[4] for r in rows}
    walks = [([10, 12, 12, 13], [0, 400, 500, 600]), ([13, 10, 10], [5, 105, 400]), ([12, 12, 12], [0, 50, 90]), ([11, 14, 12, 12], [0, 300, 900, 1000])]
    moves = [(k, p, a, b, None, "x" if k % 2 else None, t, u) for k, (ops, at) in enumerate(walks) for p, (a, b, t, u) in enumerate(zip(ops, ops[1:], at, at[1:], strict=False))]
    t = spark.createDataFrame(moves, "train long, pos int, op_id long, to_op_id long, dep_line string, arr_line string, p long, q long")
    t = t.select("train", "pos", "op_id", "to_op_id", "dep_line", "arr_line", F.timestamp_seconds("p").cast("timestamp_ntz").alias("planned_ts"), F.timestamp_seconds("q").cast("timestamp_ntz").alias("to_planned_ts"))
    found = network.paths(t.select(F.col("op_id").alias("src"), F.col("to_op_id").alias("dst"), "dep_line", "arr_line"), network.both_ways(links))
    tokens = network.path_tokens(found, links)
    path = {(r.src, r.dst, r.arr_line): r.path for r in tokens.collect()}
    asked = [(k, e, now, d) for k in range(len(walks)) for e in (-1, 0, 1, 2, 3) for now in (0, 100, 101, 150, 420, 900) for d in (0.0, 100.0)]
    now = spark.createDataFrame(asked, "train long, event int, now long, last_known_delay double").withColumns({"split_idx": F.col("event") + 2, "snapshot_ts": F.timestamp_seconds("now").cast("timestamp_ntz")})
    got = {(r.train, r.event, r.now, r.last_known_delay): r.tokens for r in network.with_tokens(now.join(network.journey_hops(t, tokens, ["train"]), "train", "left"), 4, 1).collect()}
    assert len(got) == len(asked)
    for k, e, at, d in asked:
        ops, plan = walks[k]
        steps = [path[(a, b, "x" if k % 2 else None)] for a, b in zip(ops, ops[1:], strict=False)]
        assert got[(k, e, at, d)] == window_by_hand(steps, ops, plan, e, at, d, 4, lengths, ends), (k, e, at, d)
    assert got[(0, -1, 0, 0.0)] == ["", "1uv", "2vu", "STOPPED@op12to3"] and got[(0, 1, 420, 0.0)] == ["STOPPED@op12to3", "3uv", "", ""] and got[(0, 3, 900, 0.0)] == [""] * 4
    assert got[(0, 0, 100, 0.0)][0] == "1uv" and got[(0, 0, 101, 0.0)][0] == "2vu" and got[(0, 0, 150, 100.0)][0] == "1uv"
    broken = spark.createDataFrame([(10, 13, None, None, [1, 3])], "src long, dst long, dep_line string, arr_line string, path array<long>")
    with pytest.raises(Exception, match="does not begin"):
        network.path_tokens(broken, links).collect()
    with pytest.raises(ValueError, match="does not begin"):
        network.oriented_tokens(13, [1], ends)


def test_trains_ahead(spark):
    rows = [("s", k, ["7uv", "8uv"], 10 * (k + 1), float(d)) for k, d in enumerate((5, 15, 40))] + [("s", 3, ["8uv", ""], 5, 100.0), ("s", 4, ["", "7uv"], 1, 9.0)]
    df = spark.createDataFrame(rows, "snapshot_ts string, journey_ord int, tokens array<string>, planned_1 int, last_known_delay double")
    got = {(r.journey_ord, r.link_slot): (r.n_trains, r.mean_delay) for r in network.crowding(df).collect()}
    assert [got[(k, 0)] for k in range(3)] == [(0, None), (1, 5.0), (2, 10.0)]
    assert got[(0, 1)] == (1, 100.0) and got[(4, 0)] == (0, None) and got[(4, 1)] == (3, 20.0) and got[(3, 1)] == (0, None)


def test_node_links(spark):
    v = [(0.0, 50.0, 1), (0.01, 50.0, None), (0.02, 50.0, 2), (0.03, 50.0, 3)]
    df = spark.createDataFrame([(1, "S", v)], "section_order int, line_section_id string, vertices array<struct<lon:double,lat:double,op_id:long>>")
    out = network.node_links(df).orderBy("link_id").collect()
    assert [(r.u_node_id, r.v_node_id) for r in out] == [(1, 2), (2, 3)]
    assert out[0].distance_m == pytest.approx(2 * out[1].distance_m, rel=1e-6)


def test_names_and_overrides(spark):
    n = spark.createDataFrame([(1, "X", 1.0, 2.0), (2, "X", 1.0, 2.0), (3, "Y", 1.0, 2.0)], "op_id long, op_name string, lat double, lon double")
    assert [r.op_name for r in network.unique_names(n).orderBy("op_id").collect()] == ["X", "X_2", "Y"]
    p = spark.createDataFrame([(2, 9.0, 8.0)], "op_id long, lat double, lon double")
    assert [(r.lat, r.lon) for r in network.override_places(n, p).orderBy("op_id").collect()] == [(1, 2), (9, 8), (1, 2)]


def test_snap():
    line = [[4.0, 50.0], [4.01, 50.0], [4.02, 50.0]]
    nodes = [(1, 4.0, 50.0), (3, 4.01, 50.0), (5, 4.005, 50.0001), (6, 4.005, 50.01), (9, 4.02, 50.0)]
    vertices, matched = geometry.snap(line, 1, 9, nodes)
    assert matched == [1, 5, 3, 9] and vertices[1][0] == pytest.approx(4.005, abs=1e-5)


def test_points_and_embedding():
    assert geometry.point_at([[0, 0], [1, 0], [1, 3]], 0.5) == (1.0, 1.0)
    e = geometry.laplacian_embedding([(k, (k + 1) % 12) for k in range(12)], 4)
    assert len(e) == 12 and all(np.linalg.norm(v) == pytest.approx(1) for v in e.values())


def train(key, plan, path, event, delay=0.0, ops=None):
    n = len(plan)
    return simulate.Train((key, "d"), "IC", ops or list(range(10, 10 + n)), ["P"] * n, ["L"] * n, ["L"] * n, plan, path, event, delay)


def test_headway():
    net = simulate.Network({1: 1000.0, 2: 1000.0}, {1: (10, 11), 2: (11, 12)}, {})
    lead, follow = train("a", [0, 300, 600], [[1], [2]], 0), train("b", [10, 200, 400], [[1], [2]], 0)
    out = net.run([lead, follow], 50)
    assert out[("a", "d")] == [0.0, 0.0]
    assert out[("b", "d")][0] == 300 + simulate.HEADWAY_S - 200  # held behind the leader


def test_simulation_alone_keeps_its_plan():
    net = simulate.Network({1: 1000.0}, {1: (10, 11)}, {})
    assert net.run([train("a", [100, 200, 260], [[1], []], -1, ops=[10, 11, 11])], 0)[("a", "d")] == [0.0, 0.0, 0.0]
    late = net.run([train("a", [100, 200, 260], [[1], []], 0, 30.0, ops=[10, 11, 11])], 140)
    assert late[("a", "d")] == [30.0, 30.0]


def test_expected_time_uses_quantiles_and_floor(spark):
    stats = {(10, "P", "L", 11, "P", "L", "IC"): (None, 0.0, 70.0)}
    net = simulate.Network({1: 1000.0}, {1: (10, 11)}, stats)
    t = train("a", [0, 100], [[1]], 0)
    assert net.legs_of(t, 0, 0.0) == [("1uv", 100.0)] and net.legs_of(t, 0, 50.0) == [("1uv", 70.0)]


def test_a_token_of_another_kind_is_an_error(spark):
    links = spark.createDataFrame([(7, 120.0)], "link_id long, distance_m double")
    rows = lambda *t: spark.createDataFrame([(x,) for x in t], "tok string")
    got = {r.tok: r.metres for r in network.token_lengths(rows("", None, "STOPPED@op3toEND", "7uv", "7vu"), links).collect()}
    assert got == {"": 0.0, None: 0.0, "STOPPED@op3toEND": 0.0, "7uv": 120.0, "7vu": 120.0}
    for wrong in ("8uv", "7xx", "uv"):
        with pytest.raises(Exception, match="no length for token"):
            network.token_lengths(rows(wrong), links).collect()


def test_what_is_shipped_has_a_checked_size(spark, monkeypatch):
    links = spark.createDataFrame([(k, k, k + 1, 1.0) for k in range(5)], "link_id long, u_node_id long, v_node_id long, distance_m double")
    monkeypatch.setattr(network, "MAX_SHIPPED_LINKS", 4)
    with pytest.raises(ValueError, match="at most 4"):
        network.shipped_links(links)
    monkeypatch.setattr(geometry, "MOST_EDGES", 4)
    with pytest.raises(ValueError, match="more than 4"):
        geometry.shipped_edges(links)
    assert len(geometry.shipped_edges(links.limit(4))) == 4


def test_part_of_a_line_in_both_directions(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],)], "p array<int>")
    part = lambda a, b: df.select(geometry.sub_line("p", F.lit(a), F.lit(b)).alias("x")).first().x
    assert part(1, 3) == [2, 3, 4] and part(3, 1) == [4, 3, 2] and part(2, 2) == [3]


def test_a_path_without_length_is_an_error():
    net = simulate.Network({1: 0.0}, {1: (10, 11)}, {})
    with pytest.raises(ValueError, match="no length"):
        net.run([train("a", [100, 200], [[1]], 0)], 150)


def test_sampled_seconds_over_midnight(spark):
    import numpy as np

    from waymark.operators import intervals

    rows = [("2024-01-01 23:59:50", "2024-01-02 00:00:10"), ("2024-01-02 00:00:05", "2024-01-02 00:00:20"), ("2024-01-03 10:00:00", "2024-01-03 10:00:05")]
    df = spark.createDataFrame(rows, "a string, b string").select(F.col("a").cast("timestamp_ntz").alias("appearance_start"), F.col("b").cast("timestamp_ntz").alias("disappearance_end"))
    us = lambda t: int(np.datetime64(t, "us").astype(int))
    got = intervals.sample_active_seconds(df, us("2024-01-01"), us("2024-01-04"), 35, np.random.default_rng(1))
    first, last = us("2024-01-01T23:59:50") // 10**6, us("2024-01-03T10:00:00") // 10**6
    assert got == [*range(first, first + 30), *range(last, last + 5)]


def test_links_are_numbered_over_all_sections(spark):
    v = lambda *ids: [(float(k), 50.0, i) for k, i in enumerate(ids)]
    df = spark.createDataFrame([(2, "b", v(1, None, 2, 3)), (1, "a", v(4, 5)), (3, "c", v(9, None))], "section_order int, line_section_id string, vertices array<struct<lon:double,lat:double,op_id:long>>")
    got = sorted((r.link_id, r.u_node_id, r.v_node_id) for r in network.node_links(df).collect())
    assert got == [(1, 4, 5), (2, 1, 2), (3, 2, 3)]


def test_unreachable(spark):
    """A missing path is NULL, and fails a run that needs all of them."""
    links = spark.sql("SELECT 1L AS link_id, 1L AS u_node_id, 2L AS v_node_id, 10D AS distance_m, 'L' AS line_id")
    asked = spark.sql("SELECT * FROM VALUES (1L, 2L, 'L', 'L'), (1L, 9L, 'L', 'L'), (3L, 3L, 'L', 'L') AS t(src, dst, dep_line, arr_line)")
    found = network.paths(asked, network.both_ways(links))
    assert {(r.src, r.dst): r.path for r in found.collect()} == {(1, 2): [1], (1, 9): None, (3, 3): []}
    with pytest.raises(Exception, match="no path: 1 to 9"):
        network.reachable(found).collect()
    assert network.reachable(found.where("dst <> 9")).count() == 2


def on_two_links(spark, n=2):
    """(active, links): n trains one behind the other over two links, at a stop of 100 s each."""
    links = spark.createDataFrame([(1, 10, 11, 1000.0), (2, 11, 12, 1000.0)], "link_id long, u_node_id long, v_node_id long, distance_m double")
    t0 = 1_704_067_200
    rows = [(f"t{k}", "d", "IC", 0, 0.0, [[1], [2]], [(10 + j, "P", "L", "L", t0 + 10 * k + 300 * j) for j in range(3)]) for k in range(n)]
    active = spark.createDataFrame(rows, "train_id string, service_date string, train_relation string, event_idx int, last_known_delay double, path array<array<long>>, events array<struct<op_id:long,event_type:string,line_dep:string,line_arr:string,planned_s:long>>")
    return active.withColumn("snapshot_ts", F.lit("2024-01-01 00:01:40").cast("timestamp_ntz")), links


def test_travel_times_meet_the_trains_in_a_join(spark, monkeypatch):
    """Not in a table that every Python worker holds: they never pass the driver."""
    active, links = on_two_links(spark)
    stats = spark.sql("SELECT 11L AS from_op_id, 'P' AS from_event_type, 'L' AS from_dep_line, 12L AS to_op_id, 'P' AS to_event_type, 'L' AS to_arr_line, 'IC' AS train_relation, 0D AS q40, 400D AS q45, 500D AS median")
    monkeypatch.setattr(type(stats), "toLocalIterator", lambda *a, **k: pytest.fail("travel times were collected"))
    got = {r.train_id: r.predictions for r in simulate.simulate(active, links, stats).collect()}
    assert got == {"t0": [0.0, 100.0], "t1": [30.0, 130.0]}
    assert {r.train_id: r.predictions for r in simulate.simulate(active, links).collect()} == {"t0": [0.0, 0.0], "t1": [30.0, 30.0]}


def test_a_train_takes_few_bytes():
    import tracemalloc

    n = 20_000
    at = lambda k: np.arange(n + 1, dtype=np.int64) * k
    fleet = simulate.Fleet(np.zeros(n, np.int64), np.zeros(n), at(3), (np.arange(n)[:, None] + np.array([0, 300, 600])).ravel(), np.tile([10, 11, 12], n), at(2), np.full(2 * n, np.nan), np.arange(2 * n + 1), np.tile([1, 2], n))
    net = simulate.Network({1: 1000.0, 2: 1000.0}, {1: (10, 11), 2: (11, 12)}, {})
    tracemalloc.start()
    out_at, out = net.forecast(fleet, np.arange(n), 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 2 * n and peak < 600 * n
