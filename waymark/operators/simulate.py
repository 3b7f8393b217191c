"""Discrete-event forecast: trains advance over their paths from a snapshot, keeping a headway on shared links.

Snapshots are independent, so each is one group of one task; a group holds the trains active at
one moment, never the history, as flat arrays of numbers: some 300 bytes a train. Travel times
meet the transitions in a Spark join.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .network import oriented_tokens, shipped_links, spread

#: Seconds between two trains on a place, and the margin of a stop.
HEADWAY_S, MARGIN_S = 40, 300
#: Expected times are the first of these that is there and positive, else the schedule.
QUANTILES = ("q40", "q45", "median")
#: Tasks for each place of the session: snapshots differ in size, and few of them should meet in one task.
TASKS_A_PLACE = 8


def expected_seconds(planned, delay, q40, q45, median):
    """Column form: expected time of a transition, never so short that the train would be early by more than its delay."""
    good = lambda c: F.when(c > 0, c)
    return F.greatest(F.coalesce(good(q40), good(q45), good(median), planned), planned - delay)


@dataclass(eq=False)
class Train:
    key: tuple[str, str]
    relation: str
    ops: list[int]
    kinds: list[str]
    dep: list[str]
    arr: list[str]
    plan: list[int]  # seconds
    path: list[list[int]]
    event: int
    delay: float


def flat(lists, kind) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of lists of numbers."""
    at = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=at[1:])
    return at, np.fromiter((v for x in lists for v in x), kind, int(at[-1]))


@dataclass(eq=False)
class Fleet:
    """The trains of one snapshot, one array for each thing: a train's events and transitions, and a transition's links, lie between two offsets."""

    event: np.ndarray
    delay: np.ndarray
    plan_at: np.ndarray
    plan: np.ndarray  # seconds
    op: np.ndarray
    hop_at: np.ndarray
    base: np.ndarray  # expected seconds of a transition; NaN: as planned
    link_at: np.ndarray
    link: np.ndarray


class Network:
    """Links, who was the last to enter each, and the clock."""

    def __init__(self, lengths: dict[int, float], ends: dict[int, tuple[int, int]], stats: dict):
        self.lengths, self.ends, self.stats = lengths, ends, stats
        self.ids = np.array(sorted(lengths), np.int64)
        self.metres = array("d", [lengths[x] for x in self.ids.tolist()])
        self.u, self.v = (np.array([ends[x][k] for x in self.ids.tolist()], np.int64) for k in (0, 1))

    def known(self, t: Train, k: int) -> float | None:
        """The expected seconds of transition k, if a quantile is there."""
        row = self.stats.get((t.ops[k], t.kinds[k], t.dep[k], t.ops[k + 1], t.kinds[k + 1], t.arr[k + 1], t.relation), ())
        return next((q for q in row if q is not None and q > 0), None)

    def legs_of(self, t: Train, k: int, delay: float) -> list[tuple[str, float]]:
        """The links of transition k, or the stop it stands for, with the time on each."""
        planned, known = float(t.plan[k + 1] - t.plan[k]), self.known(t, k)
        total = max(planned if known is None else known, planned - delay)
        if not t.path[k]:
            return [(f"STOPPED@op{t.ops[k]}", total)]
        lengths = [self.lengths[x] for x in t.path[k]]
        return [(tok, total * d / sum(lengths)) for tok, d in zip(oriented_tokens(t.ops[k], t.path[k], self.ends), lengths, strict=True)]

    def run(self, trains: list[Train], now: int) -> dict[tuple[str, str], list[float]]:
        """Delays at the events each train passes from now on; of trains that get somewhere at the same time, the earlier in the list was first."""
        order = sorted(range(len(trains)), key=lambda i: trains[i].key)
        by_key = [trains[i] for i in order]
        (plan_at, plan), (_, op), (hop_at, _) = flat([t.plan for t in by_key], np.int64), flat([t.ops for t in by_key], np.int64), flat([t.path for t in by_key], object)
        known = [self.known(t, k) if k + 1 < len(t.plan) else None for t in by_key for k in range(len(t.path))]
        link_at, link = flat([p for t in by_key for p in t.path], np.int64)
        fleet = Fleet(np.array([t.event for t in by_key], np.int64), np.array([t.delay for t in by_key], float), plan_at, plan, op, hop_at, np.array([math.nan if q is None else q for q in known], float), link_at, link)
        out_at, out = self.forecast(fleet, np.argsort(order), now)
        return {t.key: out[a:z].tolist() for t, a, z in zip(by_key, out_at, out_at[1:], strict=False)}

    def ahead(self, f: Fleet) -> tuple[np.ndarray, np.ndarray]:
        """(planned, base) seconds of the transitions and, in ``f.link``, places instead of links: twice the link's number, and one more against its direction.

        Transitions that lie behind a train are left as they are; what is wrong with one ahead is an error."""
        trains, hops = np.diff(f.hop_at), len(f.base)
        of = np.repeat(np.arange(len(trains)), trains)  # the train of each transition
        k = np.arange(hops) - f.hop_at[of]
        coming = k >= f.event[of]
        event = f.plan_at[of] + k
        if np.any(coming & (event + 1 >= f.plan_at[of + 1])):
            raise IndexError("a path has more transitions than its train has events")
        event = np.minimum(event, max(0, len(f.plan) - 2))
        planned = (f.plan[event + 1] - f.plan[event]).astype(float) if hops else np.zeros(0)
        base = np.where(np.isnan(f.base), planned, f.base)
        if np.any(wrong := coming & (base < 0)):
            raise ValueError(f"transition {k[wrong][0]} of a train takes {base[wrong][0]} s")
        size = np.diff(f.link_at)
        node, step = f.op[event] if hops else np.zeros(0, np.int64), 0
        going = np.flatnonzero(coming & (size > 0))
        number = np.searchsorted(self.ids, f.link)
        whole = np.zeros(hops)
        while len(going):
            at = f.link_at[going] + step
            x, here = number[at], node[going]
            if np.any(lacking := (x >= len(self.ids)) | (self.ids[np.minimum(x, len(self.ids) - 1)] != f.link[at])):
                raise KeyError(int(f.link[at][lacking][0]))
            u, v = self.u[x], self.v[x]
            if np.any(apart := (here != u) & (here != v)):
                raise ValueError(f"link {f.link[at][apart][0]} ({u[apart][0]}, {v[apart][0]}) does not begin at node {here[apart][0]}")
            f.link[at] = 2 * x + (here != u)
            node[going] = np.where(here == u, v, u)
            whole[going] += np.asarray(self.metres)[x]
            step += 1
            done = size[going] == step
            if np.any(flat_ := done & (whole[going] <= 0)):
                raise ValueError(f"transition {k[going][flat_][0]} of a train has no length")
            going = going[~done]
        return planned, base

    def forecast(self, fleet: Fleet, first: np.ndarray, now: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, values): the delays at the events each train passes from now on.

        Trains come in the order in which they leave a place at the same time; ``first`` ranks those that entered at the same time."""
        planned, base = (memoryview(x) for x in self.ahead(fleet))
        n = len(fleet.event)
        n_hops = np.diff(fleet.hop_at)
        out_at = np.zeros(n + 1, np.int64)
        np.cumsum(np.where(fleet.event < n_hops, n_hops - np.maximum(fleet.event, -1), 0), out=out_at[1:])
        out = array("d", bytes(8 * int(out_at[-1])))
        plan, plan_at, hop_at, link_at, place, metres = memoryview(fleet.plan), memoryview(fleet.plan_at), memoryview(fleet.hop_at), memoryview(fleet.link_at), memoryview(fleet.link), self.metres
        event, delay, passed = array("q", fleet.event.tobytes()), array("d", fleet.delay.tobytes()), array("q", out_at[:-1].tobytes())
        finish, entered = array("q", bytes(8 * n)), np.zeros(n, np.int64)
        leg, end = array("q", bytes(8 * n)), array("q", bytes(8 * n))  # places of the transition under way, the present one and the one after the last
        total, length = array("d", bytes(8 * n)), array("d", bytes(8 * n))
        last, on = array("q", bytes(16 * len(metres))), array("q", bytes(16 * len(metres)))  # when the last train leaves a place, and how many are there
        ceil = math.ceil

        def begin(i: int) -> None:
            h = hop_at[i] + event[i]
            leg[i], end[i] = link_at[h], link_at[h + 1]
            total[i] = max(base[h], planned[h] - delay[i])
            length[i] = sum([metres[p >> 1] for p in place[leg[i] : end[i]]])

        moving = []
        for i in range(n):
            k = event[i]
            if k >= hop_at[i + 1] - hop_at[i]:
                continue  # arrived: it holds nobody up
            moving.append(i)
            if k < 0:
                finish[i], entered[i] = max(plan[plan_at[i]], now + 1), now
                continue
            begin(i)
            begun, at, z = plan[plan_at[i] + k] + delay[i], leg[i], end[i]
            seconds = [total[i] * metres[p >> 1] / length[i] for p in place[at:z]] or [total[i]]
            cum = list(accumulate(seconds))
            j = min(bisect_left(cum, max(0.0, now - begun)), len(cum) - 1)
            leg[i] = min(at + j, z)
            finish[i], entered[i] = ceil(begun + cum[j]), math.floor(begun + cum[j] - seconds[j])
        moving = np.array(moving, np.int64)
        for i in moving[np.lexsort((first[moving], entered[moving]))].tolist():
            if event[i] >= 0 and leg[i] < end[i]:
                q = place[leg[i]]
                if on[q]:
                    finish[i] = max(finish[i], last[q] + HEADWAY_S)
                last[q] = finish[i]
                on[q] += 1
        heap = [finish[i] * n + i for i in moving.tolist()]
        heapq.heapify(heap)
        while heap:
            clock, i = divmod(heap[0], n)
            at = leg[i]
            if event[i] >= 0 and at < end[i]:
                on[place[at]] -= 1
                at += 1
            if event[i] >= 0 and at < end[i]:
                leg[i] = at
                done = ceil(clock + total[i] * metres[place[at] >> 1] / length[i])
            else:
                k = event[i] = max(event[i], -1) + 1
                if plan_at[i] + k < plan_at[i + 1]:
                    delay[i] = float(clock - plan[plan_at[i] + k])
                out[passed[i]] = delay[i]
                passed[i] += 1
                if k >= hop_at[i + 1] - hop_at[i]:
                    heapq.heappop(heap)
                    continue
                begin(i)
                at = leg[i]
                done = ceil(clock + (total[i] * metres[place[at] >> 1] / length[i] if at < end[i] else total[i]))
            if at < end[i]:
                q = place[at]
                if on[q]:
                    done = max(done, last[q] + HEADWAY_S)
                last[q] = done
                on[q] += 1
            heapq.heapreplace(heap, done * n + i)
        return out_at, np.frombuffer(out, float)


STATS_KEY = ("from_op_id", "from_event_type", "from_dep_line", "to_op_id", "to_event_type", "to_arr_line", "train_relation")


def with_expected(active: DataFrame, stats: DataFrame, on: list[str]) -> DataFrame:
    """active with ``known``: (position, seconds) of the transitions ahead that have a positive quantile. The travel times meet the transitions in a join."""
    good = lambda c: F.when((F.col(c) > 0) & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    times = stats.select(*STATS_KEY, F.coalesce(*map(good, QUANTILES)).alias("sec")).where("sec is not null").dropDuplicates(STATS_KEY)
    start = F.greatest(F.col("event_idx").cast("int"), F.lit(0))
    a, z = (lambda k: F.col("events")[k]), (lambda k: F.col("events")[k + 1])
    hop = lambda k: F.struct(
        k.alias("pos"), a(k)["op_id"].cast("bigint").alias("from_op_id"), a(k)["event_type"].alias("from_event_type"), a(k)["line_dep"].alias("from_dep_line"),
        z(k)["op_id"].cast("bigint").alias("to_op_id"), z(k)["event_type"].alias("to_event_type"), z(k)["line_arr"].alias("to_arr_line"),
    )
    many = F.when(start <= F.size("events") - 2, F.sequence(start, F.size("events") - 2))
    hops = active.select(*on, "train_relation", F.explode(F.transform(many, hop)).alias("h")).select(*on, "train_relation", "h.*")
    known = hops.join(times, list(STATS_KEY)).groupBy(*on).agg(F.collect_list(F.struct("pos", "sec")).alias("known"))
    return active.join(known, on, "left")


def simulate(active: DataFrame, links: DataFrame, stats: DataFrame | None = None, snapshot: str = "snapshot_ts") -> DataFrame:
    """active(snapshot, train_id, service_date, train_relation, event_idx, last_known_delay, path, events array<struct<
    op_id, event_type, line_dep, line_arr, planned_s>>) -> (snapshot, train_id, service_date, predictions)."""
    lengths, ends = shipped_links(links)
    on = [snapshot, "train_id", "service_date"]
    none = F.array().cast("array<struct<pos:int,sec:double>>")
    rows = active.withColumn("known", none) if stats is None else with_expected(active, stats, on)
    rows = rows.select(
        *on, F.col("event_idx").cast("bigint").alias("event"), F.coalesce(F.nanvl(F.col("last_known_delay").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("delay"), F.coalesce("path", F.array().cast("array<array<bigint>>")).cast("array<array<bigint>>").alias("path"),
        F.transform("events", lambda e: e["planned_s"].cast("bigint")).alias("plan"), F.transform("events", lambda e: e["op_id"].cast("bigint")).alias("op"), F.coalesce("known", none).alias("known"),
    )
    made: list[Network] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Network(lengths, ends, {}))
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        rows = rows.take(rows.select(on[1:]).append_column("row", pa.array(np.arange(len(rows)))).sort_by([("train_id", "ascending"), ("service_date", "ascending"), ("row", "ascending")])["row"])
        first = np.empty(len(rows), np.int64)
        first[rows.select(on[1:]).append_column("row", pa.array(np.arange(len(rows)))).sort_by([("service_date", "ascending"), ("train_id", "ascending"), ("row", "ascending")])["row"].to_numpy()] = np.arange(len(rows))
        column = lambda c: rows[c].combine_chunks()
        at = lambda x: x.offsets.to_numpy().astype(np.int64) - x.offsets[0].as_py()
        plan, op, path, known = map(column, ("plan", "op", "path", "known"))
        hop_at, paths, sec = at(path), path.flatten(), known.flatten()
        base = np.full(len(paths), math.nan)
        pos, of = sec.field("pos").to_numpy(), np.repeat(np.arange(len(rows)), np.diff(at(known)))
        there = pos < np.diff(hop_at)[of]
        base[hop_at[of[there]] + pos[there]] = sec.field("sec").to_numpy()[there]
        fleet = Fleet(column("event").to_numpy(), column("delay").to_numpy(), at(plan), plan.flatten().to_numpy(), op.flatten().to_numpy(), hop_at, base, at(paths), paths.flatten().to_numpy(zero_copy_only=False).copy())
        now = int(rows[snapshot].cast(pa.int64())[0].as_py() // 1_000_000)
        out_at, out = made[0].forecast(fleet, first, now)
        got = pa.ListArray.from_arrays(pa.array(out_at.astype(np.int32)), pa.array(out))
        yield from pa.table([rows[snapshot], rows["train_id"], rows["service_date"], got], names=[*on, "predictions"]).to_batches(10_000)

    tasks = TASKS_A_PLACE * rows.sparkSession.sparkContext.defaultParallelism
    return spread(rows, snapshot, at_least=tasks).groupBy(snapshot).applyInArrow(run, f"{snapshot} timestamp_ntz, train_id string, service_date string, predictions array<double>")


def prediction_table(keys: DataFrame, predicted: DataFrame, slots: int, snapshot: str = "snapshot_ts") -> DataFrame:
    """One row for each key: future_delay_1.. from the list, NULL where it is too short."""
    on = [snapshot, "train_id", "service_date"]
    return keys.select(*on).join(predicted, on, "left").select(*on, *[F.get("predictions", F.lit(k)).alias(f"future_delay_{k + 1}") for k in range(slots)])
