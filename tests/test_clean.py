"""Hand-checked cases of the cleaning chain, journeys and snapshots."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import scalars as S
from waymark.operators import clean, intervals, journeys, snapshots

T0 = dt.datetime(2024, 1, 5, 10, 0, 0)
STOP = "train_id string, service_date string, seq long, op_id long, arr_line_id string, dep_line_id string, planned_arr_ts timestamp_ntz, planned_dep_ts timestamp_ntz, obs_arr_ts timestamp_ntz, obs_dep_ts timestamp_ntz"
EVENT = "train_id string, service_date string, seq long, op_id long, event_type string, planned_ts timestamp_ntz, observed_ts timestamp_ntz"


def at(sec):
    return None if sec is None else T0 + dt.timedelta(seconds=sec)


def stops(spark, rows):
    return spark.createDataFrame([(j, "d", k, k, "a", "b", at(pa), at(pd), at(oa), at(od)) for k, (j, pa, pd, oa, od) in enumerate(rows)], STOP)


def events(spark, times, observed=None):
    return spark.createDataFrame([("t", "d", k, k, "P", at(s), at((observed or times)[k])) for k, s in enumerate(times)], EVENT)


def sec(ts):
    return int((ts - T0).total_seconds())


@pytest.mark.parametrize("planned,observed,kept", [(60, 60, True), (120, 120, True), (121, 0, False), (60, 121, False)])
def test_conflicts(spark, planned, observed, kept):
    df = stops(spark, [("t", planned, 0, observed, 0), ("t", 500, 600, 500, 600)])
    out = clean.resolve_conflicts(df).orderBy("seq").collect()
    assert len(out) == (2 if kept else 0)
    if kept:
        assert out[0].planned_arr_ts == T0 and out[0].obs_arr_ts == T0 and sec(out[1].planned_arr_ts) == 500


def test_explode(spark):
    df = stops(spark, [("t", 0, 60, 5, 65), ("t", 100, 100, 101, 102), ("t", 200, None, 201, None), ("t", None, 300, None, 301)])
    out = clean.stops_to_events(df).orderBy("seq").collect()
    assert [(r.event_type, r.op_id) for r in out] == [("A", 0), ("D", 0), ("P", 1), ("A", 2), ("D", 3)]
    assert out[0].dep_line_id is None and out[0].arr_line_id == "a" and out[1].arr_line_id is None and sec(out[2].observed_ts) == 101


def test_incomplete_journey_goes(spark):
    df = stops(spark, [("t", 0, 60, 5, None), ("t", 100, 160, 100, 160), ("u", 0, 60, 0, 60)])
    assert {r.train_id for r in clean.drop_incomplete(clean.stops_to_events(df)).collect()} == {"u"}


@pytest.mark.parametrize("times,want", [([0, 100, 60, 50, 200], [0, 100, 100, 100, 200]), ([0, 200, 120, 70], None), ([0, 200, 120, 120, 50], [0, 200, 200, 200, 200])])
def test_clamp(spark, times, want):
    out = clean.clamp_backward(events(spark, times), "planned_ts", 120).orderBy("seq").collect()
    assert [sec(r.planned_ts) for r in out] == (want or [])


def test_streaks_by_hand_and_in_one_sort(spark):
    r = random.Random(7)
    cases = [[r.choice([None, *range(0, 400, 10)]) for _ in range(r.randrange(1, 12))] for _ in range(40)]
    df = spark.createDataFrame([(f"t{j}", "d", k, k, "P", at(s), at(0)) for j, times in enumerate(cases) for k, s in enumerate(times)], EVENT)
    got = {(x.train_id, x.seq): (x.top, x.streak) for x in clean.with_streaks(df, "planned_ts", "top", "streak").collect()}
    for j, times in enumerate(cases):
        top, streak = None, 0
        for k, s in enumerate(times):
            step = s - times[k - 1] if k and None not in (s, times[k - 1]) else None
            streak = 0 if step is not None and step >= 0 else streak + (step or 0)
            top = s if top is None or (s is not None and s > top) else top
            assert got[f"t{j}", k] == (at(top), streak * 1_000_000)
    plan = clean.clamp_backward(df, "planned_ts", 120)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


@pytest.mark.parametrize("delay,kept", [(14_400, True), (14_401, False), (-3_600, True), (-3_601, False)])
def test_delay_bounds(spark, delay, kept):
    df = clean.add_delay(events(spark, [0, 10], [0, 10 + delay]))
    assert (clean.bound_delays(df).count() == 2) == kept


def test_keep_first(spark):
    df = spark.createDataFrame([("t", "d", k, 7, "P") for k in (3, 1, 2)], "train_id string, service_date string, seq long, op_id long, event_type string")
    assert [r.seq for r in clean.keep_first(df, ["train_id", "op_id"]).collect()] == [1]
    assert [r.seq for r in clean.keep_last(df, ["train_id", "op_id"]).collect()] == [3]


def test_active_edges(spark):
    iv = spark.createDataFrame([(1, at(0), at(3600)), (2, at(5), at(5))], "id int, appearance_start timestamp_ntz, disappearance_end timestamp_ntz")
    pts = spark.createDataFrame([(at(s),) for s in (-1, 0, 3599, 3600)], "snapshot_ts timestamp_ntz")
    for bucket in (60, 1800, 10**7):
        out = intervals.join_active(iv, pts, bucket_us=bucket * 1_000_000).collect()
        assert sorted((r.id, sec(r.snapshot_ts)) for r in out) == [(1, 0), (1, 3599)]
        assert [r.id for r in intervals.join_active(iv, pts, bucket_us=bucket * 1_000_000, how="left_semi").collect()] == [1]


def test_no_nested_loop(spark):
    iv = spark.createDataFrame([(1, at(0), at(3600))], "id int, appearance_start timestamp_ntz, disappearance_end timestamp_ntz")
    pts = spark.createDataFrame([(at(0),)], "snapshot_ts timestamp_ntz")
    plan = intervals.join_active(iv, pts)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sampling_is_seeded_and_active(spark):
    import numpy as np

    iv = spark.createDataFrame([(at(0), at(10)), (at(5), at(20)), (at(100), at(110))], "appearance_start timestamp_ntz, disappearance_end timestamp_ntz")
    us = int((T0 - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    draw = lambda n: intervals.sample_active_seconds(iv, us, us + 3600 * 1_000_000, n, np.random.default_rng(42))
    active = {us // 1_000_000 + s for s in [*range(20), *range(100, 110)]}
    assert draw(12) == draw(12) and set(draw(30)) == active
    with pytest.raises(ValueError, match="30 active"):
        draw(31)


def slots(spark, snap):
    e = clean.add_delay(events(spark, [0, 100, 200], [10, 120, 260]))
    arrays = snapshots.padded(journeys.event_arrays(e), 2, 2, 5, 5)
    df = arrays.crossJoin(spark.createDataFrame([(at(snap),)], "snapshot_ts timestamp_ntz"))
    return snapshots.with_last_delay(snapshots.split_at(df, 2, 2)).first()


def test_padding(spark):
    before, mid, after = slots(spark, -100), slots(spark, 130), slots(spark, 270)
    assert before.past_slots[0].op_id == -1 and before.past_slots[0].delay_sec == 0 and before.past_slots[0].event_type == "D"
    assert [s.op_id for s in mid.past_slots] == [1, 0] and [s.op_id for s in mid.future_slots] == [2, -1]
    assert mid.future_slots[1].event_type == "A" and mid.future_slots[1].delay_sec == 60
    assert [s.op_id for s in after.future_slots] == [-1, -1]


@pytest.mark.parametrize("ahead,want", [(100, 60.0), (-30, 60.0), (-90, 90.0)])
def test_last_known_delay(spark, ahead, want):
    df = spark.createDataFrame([(60, at(0), at(ahead))], "d int, s timestamp_ntz, p timestamp_ntz")
    assert df.select(S.last_known_delay(F.col("d"), F.col("s"), F.col("p"))).first()[0] == want


def test_wall_clock(spark):
    df = spark.createDataFrame([("05JAN2024", "08:15:00"), ("31FEB2024", "08:15:00"), (None, "08:15:00"), ("05JAN2024", "nan")], "d string, t string")
    assert [r[0] for r in df.select(S.wall_clock(F.col("d"), F.col("t"))).collect()] == [dt.datetime(2024, 1, 5, 8, 15), None, None, None]


def test_parameters_have_types_defaults_and_older_names():
    p = clean.parameters
    assert p(None) == {k: d for k, (_, d, _) in clean.PARAMETERS.items()}
    got = p({"skew_threshold_sec": "90", "schedule_skew_threshold_sec": 80, "monotonic_threshold_sec": 60, "planned_monotonic_threshold_sec": 50, "apply_planned_monotonic": " No ", "apply_observed_monotonic": 0, "apply_intra_stop_conflicts": "maybe", "max_late_sec": 7.0, "other": 1})
    assert got["intra_stop_conflict_threshold_sec"] == 80 and got["planned_monotonic_threshold_sec"] == 50 and got["observed_monotonic_threshold_sec"] == 60 and got["max_late_sec"] == 7
    assert (got["apply_planned_monotonic"], got["apply_observed_monotonic"], got["apply_intra_stop_conflicts"]) == (False, False, True) and "other" not in got
    with pytest.raises(ValueError):
        p({"max_early_sec": "soon"})


def test_switches_of_the_chain(spark, monkeypatch):
    """A step that is switched off is not taken, and thresholds arrive where they belong."""
    taken = []
    stops = spark.createDataFrame([("1", "2024-01-05", 1, 7, "a", "a", T0, T0, T0, T0)], STOP)
    for name in ("resolve_conflicts", "clamp_backward"):
        step = getattr(clean, name)
        monkeypatch.setattr(clean, name, lambda df, *a, step=step, name=name, **k: taken.append((name, *[x for x in a if x != clean.JOURNEY])) or step(df, *a, **k))
    both = [clean.build_events(stops, params=p).count() for p in (None, {"apply_intra_stop_conflicts": "off", "apply_planned_monotonic": "no", "observed_monotonic_threshold_sec": 30})]
    assert both[0] == both[1] > 0
    assert taken == [("resolve_conflicts", 120), ("clamp_backward", "planned_ts", 120), ("clamp_backward", "observed_ts", 120), ("clamp_backward", "observed_ts", 30)]


@pytest.mark.parametrize("by_journey", [False, True])
def test_large_stop_tables_are_dealt_to_more_tasks(spark, monkeypatch, by_journey):
    """A task's share of the stop records stays the same, and so do the records."""
    from waymark.plans import adapter as A

    sf = "/root/testdata/sf0.001"
    before = sorted(A.stops(spark, sf).collect())
    monkeypatch.setattr(A, "STOPS_A_TASK", 200)
    many = A.stops(spark, sf, by_journey) if by_journey else A.stops(spark, sf)
    assert many.rdd.getNumPartitions() == -(-len(before) // 200) and sorted(many.collect()) == before
    if by_journey:
        assert clean.resolve_conflicts(many).rdd.getNumPartitions() == -(-len(before) // 200)
