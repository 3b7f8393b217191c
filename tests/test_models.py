"""Cached paths, padded batches and inference, feature specifications, the chunked source."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import batches, network, specification
from waymark.sources import chunked, scratch

LINKS = "link_id long, u_node_id long, v_node_id long, line_id string, distance_m double"


def test_paths_are_searched_once(spark, tmp_path):
    links = spark.createDataFrame([(1, 1, 2, "x", 5.0), (2, 2, 3, "y", 5.0), (3, 3, 4, "y", 1.0)], LINKS)
    ask = lambda rows: spark.createDataFrame(rows, "src long, dst long, dep_line string, arr_line string")
    store, searched = f"{tmp_path}/paths", []

    def search(requests, edges):
        searched.append(requests.count())
        return network.paths(requests, edges)

    run = lambda rows, li=links: sorted((r.src, r.dst, r.dep_line, r.path) for r in network.cached_paths(ask(rows), li, store, len(searched), search).collect())
    first = [(1, 3, None, None), (3, 1, "x", None), (1, 9, None, None)]
    want = sorted((r.src, r.dst, r.dep_line, r.path) for r in network.paths(ask(first), network.both_ways(links)).collect())
    key = lambda t: (t[0], t[1])
    assert sorted(run(first), key=key) == sorted(want, key=key) and searched == [3]
    assert sorted(run(first + first), key=key) == sorted(want, key=key) and searched == [3]  # nothing is searched, also no path that does not exist
    assert run([(1, 4, None, None), (1, 3, None, None)]) == [(1, 3, None, [1, 2]), (1, 4, None, [1, 2, 3])] and searched == [3, 1]
    other = links.withColumn("distance_m", F.when(F.col("link_id") == 2, 6.0).otherwise(F.col("distance_m")))
    assert run([(1, 3, None, None)], other) == [(1, 3, None, [1, 2])] and searched == [3, 1, 1]  # another network has paths of its own
    assert run([(1, 3, None, None)], links.orderBy(F.desc("link_id"))) == [(1, 3, None, [1, 2])] and searched == [3, 1, 1]
    marks = {network.fingerprint(x) for x in (links, other, links.limit(2), links.union(links.limit(1)))}
    assert len(marks) == 4 and network.fingerprint(links.repartition(3)) in marks
    assert network.cached_paths(ask([]), links, f"{tmp_path}/none").count() == 0


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    """Workers find this module's functions by name."""
    spark.sparkContext.addPyFile(__file__)


@pytest.fixture(scope="module")
def trains(spark):
    r = random.Random(2)
    rows = [(f"s{k:02d}", j, r.gauss(0, 5), r.random()) for k in range(40) for j in range(r.choice((1, 2, 3, 4, 5, 9, 17, 70)))]
    return spark.createDataFrame(rows, "snapshot_ts string, node long, a double, b double")


def test_no_snapshot_is_split(trains):
    sizes = {r.snapshot_ts: r.n for r in trains.groupBy("snapshot_ts").agg(F.count("*").alias("n")).collect()}
    p = batches.padded(trains, ["a", "b"], "node", limit=32)
    got = p.collect()
    assert len(got) == 40
    for r in got:
        assert r.n == sizes[r.snapshot_ts] and r.width == 1 << (r.n - 1).bit_length() and len(r.x) == len(r["mask"]) == r.width
        assert r["mask"] == [1] * r.n + [0] * (r.width - r.n) and r.ids == list(range(r.n)) and all(v == [0.0, 0.0] for v in r.x[r.n :])
    seen = []
    for b in batches.batches(p).collect():
        seen += b.snapshots
        assert b.n_places <= 32 or len(b.snapshots) == 1
        assert b.n_places == b.width * len(b.snapshots) and b.n_trains == sum(sizes[s] for s in b.snapshots) and b.padding == pytest.approx(1 - b.n_trains / b.n_places) and b.padding < 0.5
    assert sorted(seen) == sorted(sizes)


def model():
    def run(x, mask):
        return x[:, :, 0] * 2 + (x[:, :, 1] * mask).sum(1, keepdims=True) / mask.sum(1, keepdims=True)

    return run


def test_batches_predict_what_rows_predict(trains):
    got = {(r.snapshot_ts, r.id): r.prediction for r in batches.predicted(batches.padded(trains, ["a", "b"], "node"), model, 2, batch_size=3).collect()}
    rows = trains.collect()
    by = {}
    for r in rows:
        by.setdefault(r.snapshot_ts, []).append(r)
    assert len(got) == len(rows)
    for s, own in by.items():
        alone = model()(np.array([[[r.a, r.b] for r in own]]), np.ones((1, len(own))))[0]
        assert [got[(s, r.node)] for r in own] == pytest.approx(alone.tolist(), rel=1e-12)
    assert batches.predicted(batches.padded(trains.limit(0), ["a", "b"], "node"), model, 2).count() == 0


def test_specification_beside_the_data(spark, tmp_path):
    rows = spark.createDataFrame([(k, "train" if k < 6 else "test", float(k * k), float(k), 4.0, None if k % 2 else 1.0) for k in range(9)], "id long, split string, a double, b double, c double, d double")
    spec = specification.learned(rows, z=["a", "c", "d"], scaled=["b"])
    specification.write(rows.where("split = 'train'"), spec, f"{tmp_path}/t")
    table, back = specification.read(spark, f"{tmp_path}/t")
    assert back == spec and table.count() == 6
    a = np.arange(6.0) ** 2
    out = specification.applied(rows, back).orderBy("id").collect()
    assert [r.a for r in out] == pytest.approx(((np.arange(9.0) ** 2 - a.mean()) / a.std(ddof=1)).tolist())
    assert [r.b for r in out] == [0.0, 0.2, 0.4, 0.6, 0.8, 1.0, 1.0, 1.0, 1.0] and {r.c for r in out} == {0.0} and [r.d for r in out][:2] == [0.0, None]
    undone = specification.undone(specification.applied(rows, back), back).where("split = 'train'").orderBy("id").collect()
    for r, x in zip(undone, rows.where("split = 'train'").orderBy("id").collect(), strict=True):
        assert all(r[c] == pytest.approx(x[c]) if x[c] is not None else r[c] is None for c in "abcd")
    for wrong in (rows.select("id", "split", "b", "a", "c", "d"), rows.drop("d"), rows.withColumn("e", F.lit(1)), rows.withColumn("a", F.col("a").cast("float"))):
        with pytest.raises(ValueError, match="the specification has"):
            specification.applied(wrong, back)
    table.select("id", "b", "split", "a", "c", "d").write.parquet(f"{tmp_path}/other")
    spark.read.text(f"{tmp_path}/t/{specification.FOLDER}").coalesce(1).write.text(f"{tmp_path}/other/{specification.FOLDER}")
    with pytest.raises(ValueError, match="column 2"):
        specification.read(spark, f"{tmp_path}/other")


def test_days_of_the_months():
    assert chunked.day_range("202301", "202402") == (dt.date(2022, 12, 31), dt.date(2024, 3, 1))
    with pytest.raises(ValueError):
        chunked.day_range("202302", "202301")


def service(stations, first, last, options):
    """Fails the first time for every chunk, and always for station 13; counts its calls in files."""
    import os
    import uuid

    at = f"{options['log']}/{'-'.join(map(str, stations))}"
    os.makedirs(at, exist_ok=True)
    tries = len(os.listdir(at))
    open(f"{at}/{uuid.uuid4().hex}", "w").close()
    if tries == 0 or 13 in stations:
        raise OSError("no answer")
    for s in stations:
        yield s, dt.datetime.combine(first, dt.time(3)), float(s)
        if options.get("stray"):
            yield s, dt.datetime.combine(last, dt.time(3)) + dt.timedelta(days=1), 0.0


def test_chunks_are_asked_for_again(spark, tmp_path):
    import os

    ask = lambda stations, log, **more: chunked.read_chunks(spark, stations, dt.date(2024, 1, 1), dt.date(2024, 1, 2), "test_models:service", log=f"{tmp_path}/{log}", wait=0.01, **more)
    rows = ask(list(range(7)), "a", chunk=3)
    assert rows.rdd.getNumPartitions() == 3
    assert sorted((r.op_id, r.value) for r in rows.collect()) == [(k, float(k)) for k in range(7)]
    assert {c: len(os.listdir(tmp_path / "a" / c)) for c in os.listdir(tmp_path / "a")} == {"0-1-2": 2, "3-4-5": 2, "6": 2}
    with pytest.raises(Exception, match=r"stations \[13\]: no answer in 3 tries"):
        ask([13], "b", retries=2).collect()
    with pytest.raises(Exception, match="not asked for"):
        ask([4], "c", stray=1).collect()
    assert ask([], "d").count() == 0


def test_search_draws_ranks_and_stops(spark):
    from waymark.operators import search

    space = {
        "kind": {"choice": ["a", "b"]}, "depth": {"int": (2, 5)}, "rate": {"float": (1e-4, 1e-1), "log": True}, "share": {"float": (0.5, 1.0)},
        "extra": {"int": (1, 9), "when": lambda p: p["kind"] == "b"}, "leaves": {"derived": lambda p: 2 ** p["depth"]}, "seed": {"fixed": 7},
    }
    calls = []

    def score(p, budget):
        spark.range(10).count()
        calls.append((budget, spark.sparkContext.getLocalProperty("spark.scheduler.pool")))
        if p["depth"] == 5:
            raise ValueError("too deep")
        return p["share"] + p["rate"] - budget / 100

    one, two = (search.search(spark, space, score, 12, (1, 3, 9), at_once=k) for k in (4, 1))
    assert one == two
    rungs = [[r for r in one if r["rung"] == k] for k in range(3)]
    failed = sum(r["state"] == "failed" for r in rungs[0])
    assert len(rungs[0]) == 12 and len(rungs[1]) == min(6, 12 - failed) and len(rungs[2]) == -(-len(rungs[1]) // 2)
    for a, b in zip(rungs, rungs[1:], strict=False):
        kept = {r["trial"] for r in a if r["state"] == "kept"}
        assert kept == {r["trial"] for r in b}
        rest = [r["score"] for r in a if r["state"] == "stopped"]
        assert not rest or max(r["score"] for r in a if r["trial"] in kept) <= min(rest)
    for r in rungs[0]:
        p = r["params"]
        assert ("extra" in p) == (p["kind"] == "b") and int(p["leaves"]) == 2 ** int(p["depth"]) and 2 <= int(p["depth"]) <= 5 and 1e-4 <= float(p["rate"]) <= 1e-1 and p["seed"] == "7"
        assert (r["state"] == "failed") == (p["depth"] == "5")
    assert search.best(one)["rung"] == 2 and search.best(one)["score"] == min(r["score"] for r in rungs[2])
    assert {p for _, p in calls[: len(calls) // 2]} == {f"trials-{k}" for k in range(4)}
    assert search.table(spark, one).count() == len(one)
    with pytest.raises(ValueError, match="none of"):
        search.drawn({"x": {}}, np.random.default_rng(1))


def test_models_come_back_and_end_early(spark, tmp_path):
    from waymark.operators import boosted

    r = random.Random(1)
    rows = [(x, y, 2 * x + (y > 0.5) if k % 9 else None, r.random() if k % 4 == 0 else 2 * x, k % 4 == 0) for k, (x, y) in enumerate((r.random(), r.random()) for _ in range(400))]
    df = spark.createDataFrame(rows, "a double, b double, t double, noise double, held boolean")
    models = {"t": boosted.fit(df, ["a", "b"], "t", rounds=6, depth=3), "noise": boosted.fit(df, ["a", "b"], "noise", rounds=30, depth=3, valid="held", tolerance=0.05)}
    assert models["t"][0].getNumTrees == 6 and models["noise"][0].getNumTrees < 30
    boosted.save(models, f"{tmp_path}/m")
    again = boosted.load(f"{tmp_path}/m", ["t", "noise"])
    a, b = (sorted((x.a, x.predicted_t, x.predicted_noise) for x in boosted.predictions(m, df).collect()) for m in (models, again))
    assert a == b and len(a) == 400
    assert boosted.errors(again["t"], df, "t").first().mae < 0.4


def test_fits_of_several_targets_run_at_once(spark, monkeypatch):
    """All are under way together, and each is what it is alone."""
    from threading import Barrier

    from waymark.operators import boosted

    rows = spark.range(400).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 17 * 2).cast("double").alias("y_1"), (F.col("id") % 5 * 3).cast("double").alias("y_2")).persist()
    alone, together = boosted.fit, Barrier(2, timeout=60)
    one = {y: alone(rows, ["a", "b"], y, rounds=2, depth=2)[0].toDebugString for y in ("y_1", "y_2")}
    monkeypatch.setattr(boosted, "fit", lambda *a, **k: (together.wait(), alone(*a, **k))[1])
    both = boosted.fit_all(rows, ["a", "b"], ["y_1", "y_2"], rounds=2, depth=2)
    rows.unpersist()
    tail = lambda text: text.split("\n", 1)[1]  # noqa: E731  without the model's id
    assert {y: tail(m[0].toDebugString) for y, m in both.items()} == {y: tail(t) for y, t in one.items()}


def _kept_plans(monkeypatch):
    plans, store = {}, scratch.stored
    monkeypatch.setattr(scratch, "stored", lambda df, name, *by: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or store(df, name, *by))
    return plans


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["e09", "tabular"])
def test_events_are_scanned_once(spark, monkeypatch, name):
    """For the simulation, and for the rows that models are trained on: everything else reads the table of journeys."""
    from waymark.plans import gold_queries

    plans = _kept_plans(monkeypatch)
    out = (gold_queries.simulated_table if name == "e09" else gold_queries.tabular)(spark, "/root/testdata/sf0.001")
    assert plans["journeys"].count("FileScan") == 1 and "events.parquet" in plans["journeys"]
    assert "events.parquet" not in out._jdf.queryExecution().executedPlan().toString()
