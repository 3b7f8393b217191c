"""Graph tables, mergeable statistics, tables by month: brute force, plans and files."""

import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from waymark.operators import graphs, journeys, statistics
from waymark.sources import months, scratch


@pytest.fixture(scope="module")
def values(spark):
    r = random.Random(3)
    rows = [(f"p{k % 6}", "a" if k % 3 else "b", r.gauss(1e6, 3.0) if k % 7 else None, float("nan") if k % 11 == 0 else float(k % 50)) for k in range(4000)] + [("p9", "one", 4.0, 1.0), ("p9", "none", None, None)]
    return spark.createDataFrame(rows, "period string, kind string, x double, y double")


def test_merged_statistics_are_those_of_one_pass(values):
    parts = statistics.partials(values, ["x", "y"], ["period", "kind"])
    got = {(r.kind, r.column): r for r in statistics.finished(statistics.merged(parts, ["kind"]), (0.25, 0.5)).collect()}
    assert len(got) == 8
    for (kind, column), r in got.items():
        v = [row[column] for row in values.where(F.col("kind") == kind).collect()]
        v = np.array([x for x in v if x is not None and np.isfinite(x)])
        assert r.n == len(v)
        if not len(v):
            assert r.mean is None and r["std"] is None and r.q_50 is None
            continue
        assert r.mean == pytest.approx(v.mean(), rel=1e-12) and (r.low, r.high) == (v.min(), v.max())
        assert r["std"] == pytest.approx(v.std(ddof=1) if len(v) > 1 else 0.0, rel=1e-9)
        for q in (0.25, 0.5):
            assert (v < r[f"q_{round(100 * q)}"]).mean() - 0.03 <= q <= (v <= r[f"q_{round(100 * q)}"]).mean() + 0.03


def test_merging_in_steps_is_merging_at_once(values):
    parts = statistics.partials(values, ["x"], ["period", "kind"])
    halves = [statistics.merged(parts.where(c), ["kind"]) for c in ("period < 'p3'", "period >= 'p3'")]
    a = {r.kind: r for r in statistics.finished(statistics.merged(halves[0].unionByName(halves[1]), ["kind"])).collect()}
    b = {r.kind: r for r in statistics.finished(statistics.merged(parts, ["kind"])).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].n == b[k].n and (a[k]["std"] == b[k]["std"] or a[k]["std"] == pytest.approx(b[k]["std"], rel=1e-9))


def test_a_period_is_replaced_alone(spark, values, tmp_path):
    to = f"{tmp_path}/s"
    statistics.store(statistics.partials(values, ["x"], ["period", "kind"]), to, "period")
    files = lambda: {p: sorted(f for f in os.listdir(f"{to}/{p}") if f.endswith(".parquet")) for p in os.listdir(to) if "=" in p}
    before = files()
    statistics.store(statistics.partials(values.where("period = 'p2'").withColumn("x", F.lit(1.0)), ["x"], ["period", "kind"]), to, "period")
    after = files()
    assert {p for p in before if before[p] != after[p]} == {"period=p2"}
    stored = spark.read.parquet(to)
    assert stored.where("period = 'p2'").agg(F.max("high")).first()[0] == 1.0 and stored.where("period = 'p1'").agg(F.min("low")).first()[0] > 1000


def scanned_files(df):
    """Files that the scans of a finished run have read."""
    plan, out = df._jdf.queryExecution().executedPlan(), []
    todo = [plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            out.append(p.metrics().get("numFiles").get().value())
        if name.endswith("QueryStageExec"):
            todo.append(p.plan())
        kids = p.children()
        todo += [kids.apply(k) for k in range(kids.size())]
    return out


def test_only_months_that_are_asked_for_are_read(spark, tmp_path):
    to = f"{tmp_path}/m"
    rows = spark.range(1200).select("id", F.format_string("2023%02d", (F.col("id") % 12 + 1).cast("int")).alias("month")).coalesce(1)
    months.write_months(rows, to)
    schema = "id long, month string"
    wanted = spark.createDataFrame([("202303", 1), ("202305", 2), ("202305", 3), ("209901", 4), ("odd", 5)], "month string, k int")
    out = months.read_months(spark, to, schema, wanted)
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString()
    assert {r.month for r in out.collect()} == {"202303", "202305"}
    assert scanned_files(out) == [2]
    every = months.read_months(spark, to, schema)
    assert len(every.collect()) == 1200 and scanned_files(every) == [12]
    one = every.where("month = '202307'")
    assert len(one.collect()) == 100 and scanned_files(one) == [1]
    months.write_months(rows.where("month = '202307'").limit(1), to)
    assert months.read_months(spark, to, schema).count() == 1101


DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@needs_data
def test_events_are_scanned_once_for_all_tables(spark, monkeypatch):
    from waymark.plans import graph_queries

    plans, store = {}, scratch.stored
    monkeypatch.setattr(scratch, "stored", lambda df, name, *by: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or store(df, name, *by))
    parts = graph_queries.parts(spark, DATA)
    assert plans["journeys"].count("FileScan") == 1 and "events.parquet" in plans["journeys"]
    assert "events.parquet" not in plans["states"]
    for name, df in parts.items():
        assert df.columns == graphs.LAYOUT + graphs.FEATURES
        reads = "events.parquet" in df._jdf.queryExecution().executedPlan().toString()
        assert reads == (name == "station_nodes")  # its weather is made of events in these tables


def test_compressed_edges_give_back_the_edges(spark):
    r = random.Random(5)
    edges = sorted({(s, r.randrange(7), r.randrange(9), k) for s in ("s1", "s2") for k in range(25)})
    sources = [(s, k) for s in ("s1", "s2", "s3") for k in range(8)]
    e = spark.createDataFrame(edges, "snapshot_ts string, src long, dst long, slot long")
    out = {x.snapshot_ts: x for x in graphs.adjacency(e, spark.createDataFrame(sources, "snapshot_ts string, src long"), ("slot",)).collect()}
    assert out["s3"].offsets == [0] * 9 and out["s3"].neighbours == []
    for s in ("s1", "s2"):
        o, n = out[s].offsets, out[s].neighbours
        assert len(o) == 9 and o[0] == 0 and o[-1] == len(n)
        back = [(k, d) for k in range(8) for d in n[o[k] : o[k + 1]]]
        assert back == [(a, d) for x, a, d, k in sorted(edges, key=lambda t: (t[0], t[1], t[3])) if x == s]


def test_graphs_come_in_files_of_bounded_size(spark, tmp_path):
    graphs.write_graphs(spark.range(50).coalesce(1), f"{tmp_path}/g", records=8)
    sizes = [pq.read_metadata(tmp_path / "g" / f).num_rows for f in os.listdir(tmp_path / "g") if f.endswith(".parquet")]
    assert sum(sizes) == 50 and max(sizes) <= 8


def test_transitions_from_arrays(spark):
    """The same pairs as those of the event table."""
    r = random.Random(6)
    rows = [(f"t{k % 9}", "d", k, r.randrange(20), r.randrange(900), r.randrange(900), 0, "A", "IC 1") for k in range(60)]
    e = spark.createDataFrame(rows, "train_id string, service_date string, seq long, op_id long, o long, p long, delay_sec long, event_type string, train_relation string")
    e = e.withColumns({"observed_ts": F.timestamp_seconds("o").cast("timestamp_ntz"), "planned_ts": F.timestamp_seconds("p").cast("timestamp_ntz")})
    cols = ["train_id", "pos", "seq", "op_id", "to_op_id", "planned_ts", "to_planned_ts"]
    got = graphs.transitions_of(graphs.journey_arrays(e)).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, journeys.transitions(e).select(*cols).collect()))
    a = {x.train_id: x for x in graphs.journey_arrays(e).collect()}
    for x in journeys.summarise(e).collect():
        assert all(a[x.train_id][c] == x[c] for c in ("start_planned_ts", "end_planned_ts", "start_observed_ts", "end_observed_ts"))


def test_scaling_of_tables(spark):
    rows = [("train_nodes", "train" if k < 4 else "test", None, k, None, None, float(k), 5.0, *[None] * 6) for k in range(6)] + [("past_edges", "train", None, k, 1, 1, float(k + 1), None, 2.0, *[None] * 5) for k in range(3)]
    names = graphs.LAYOUT + graphs.FEATURES
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c in ('tbl', 'split') else 'timestamp_ntz' if c == 'snapshot_ts' else 'long' if c in 'a b slot' else 'double'}" for c in names))
    out = graphs.normalised(df, graphs.feature_statistics(df)).collect()
    x = np.arange(4.0)
    trains = sorted((r.a, r.f1, r.f2) for r in out if r.tbl == "train_nodes")
    assert [t[1] for t in trains] == pytest.approx(((np.arange(6) - x.mean()) / x.std(ddof=1)).tolist()) and {t[2] for t in trains} == {5.0}
    assert sorted((r.f1, r.f2, r.f3) for r in out if r.tbl == "past_edges") == [(0.0, None, 0.0), (0.5, None, 0.0), (1.0, None, 0.0)]
