"""Hard-negative mining by dual-tree search: one tree over the anchors, one over the candidates.

Vectors become integers (floor(256 x)) and a score is an integer inner product, so results are exact. Rows
are range-sorted by label and by their leaf in a shallow tree of hyperplanes, which is fitted to a
bounded sample; consecutive rows of that order form nodes of bounded size, the lower part of the trees. A node
knows its centre, radius, labels and smallest id; below it is a binary tree down to its leaves, cut at wide gaps or in the middle between two far rows.

Each question (an anchor, and a window of scores) wants the first k rows by score. Node pairs bound the inner
product of all their rows: <a, c> -+ (ra |c| + rc |a| + ra rc). A pair is pruned for the whole group of anchors when
that interval lies below the k-th best that each question already has, or above all the windows. Pairs of
upper nodes are pruned by Spark joins of their summaries, best first, in rounds that each take eight times as many
pairs as all before, so later rounds meet tight thresholds; pairs of lower nodes inside the task that holds
the two upper ones; pairs of leaves are scored. Positives are one question for each anchor (same label, any score), negatives
one for each positive (other label, between two shares of its score).

The size of a node grows with the root of the table up to a bound, so work items are many and the bytes
shipped grow less than with the square of the rows. No crowd of equal vectors or of one label is in one task:
their rows fill as many nodes as they need.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; zero and empty
vectors do. Labels are whole numbers. Vectors of different length have no score. Integers are held within
2^26 (components of 262,144), so that scores up to 2,047 components fit a long. An anchor never meets rows of its own id,
repeated rows included; apart from that repeated rows count as so many. Ties go to the smaller id. A positive score below zero has
no window. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, written

#: Scale of the integers, anchors, positives and negatives of each, and the window of scores in percent.
SCALE, ANCHOR_EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 256, 50, 5, 3, 50, 95
LIMIT = 1 << 26  # of an integer component
#: The upper tree: rows of the sample, levels, seed of the sample.
SAMPLE, DEPTH, SEED = 16_384, 10, 20_240_601
WIDE = 0.2  # share of a split's range from which a gap is where it cuts
#: Rows of a node for each root of the table, at least and at most: candidates, anchors. Rows of a leaf: the same.
NODE, ANCHOR_NODE = (8.0, 1024, 32_768), (2.0, 128, 8192)
LEAF, ANCHOR_LEAF = 256, 64
#: Candidate nodes for each anchor node in the first round; how many times as many as before in each next one.
FIRST, GROWTH = 4, 8
RANGE_ROWS, BROADCAST_ROWS, SUMMARIES = 200_000, 1_000_000, 200
NONE = -(1 << 63)  # a threshold that every score exceeds
FOUND = "aid long, w int, id long, score long"


def usable(c: Column) -> Column:
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole_numbers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x.astype(np.float64)), -LIMIT, LIMIT).astype(np.int32)


def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(direction between two far rows, the rows' order along it, how many lie below): at a wide gap, if one is there, else in the middle."""
    far = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
    direction = x[np.argmax(((x - far) ** 2).sum(1))] - far
    along = (x * direction).sum(1)
    order = np.argsort(along, kind="stable")
    rising, n = along[order], len(x)
    least = max(1, n // 8)
    gaps = np.diff(rising)[least - 1 : n - least]
    at = int(np.argmax(gaps))
    return direction, order, least + at if gaps[at] > 0 and gaps[at] >= WIDE * (rising[-1] - rising[0]) else (n + 1) // 2


def fit_tree(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Hyperplanes (directions, thresholds) in heap order, from splits of a sample."""
    planes, cuts = np.zeros((2**depth - 1, x.shape[1]), np.float32), np.zeros(2**depth - 1, np.float32)
    parts = {0: np.arange(len(x))}
    for node in range(2**depth - 1):
        own = parts.pop(node, None)
        if own is None or len(own) < 2:
            continue
        planes[node], order, n = split(x[own])
        cuts[node] = (x[own[order[n - 1]]] * planes[node]).sum()
        parts[2 * node + 1], parts[2 * node + 2] = own[order[:n]], own[order[n:]]
    return planes, cuts


def leaf_of(x: np.ndarray, planes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for _ in range(int(math.log2(len(cuts) + 1))):
        node = 2 * node + 1 + ((x * planes[node]).sum(1) > cuts[node])
    return node - len(cuts)


def _numbers(trees: dict[int, tuple], scale: int):
    def run(batches):
        """(id, label, anchor, dim, leaf, vec): vec as little-endian 32-bit integers."""
        for b in batches:
            values, dims = whole_numbers(b.column(3).flatten().to_numpy(zero_copy_only=False), scale), np.asarray(b.column(4))
            ends = np.cumsum(dims)
            leaf = np.zeros(len(dims), np.int64)
            for dim in set(dims.tolist()) & set(trees):
                at = np.flatnonzero(dims == dim)
                leaf[at] = leaf_of(values[(ends[at] - dim)[:, None] + np.arange(dim)].astype(np.float32), *trees[dim])
            vecs = [values[e - n : e].astype("<i4").tobytes() for e, n in zip(ends.tolist(), dims.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(leaf), pa.array(vecs, pa.binary())], ["id", "label", "anchor", "dim", "leaf", "vec"])

    return run, "id long, label long, anchor boolean, dim int, leaf long, vec binary"


def grow(x: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, rows (place, level) of the cuts) of a tree of splits with leaves of at most ``leaf`` rows."""
    order, cuts, open_ = np.arange(len(x)), [], [(0, len(x), 1)]
    while open_:
        a, b, level = open_.pop()
        if b - a > leaf:
            _, part, n = split(x[order[a:b]])
            order[a:b] = order[a:b][part]
            cuts.append((a + n, level))
            open_ += [(a, a + n, level + 1), (a + n, b, level + 1)]
    return order, np.array(cuts, "<i8").reshape(-1, 2)


def levels_of(cuts: np.ndarray, n: int) -> list[np.ndarray]:
    """Where the nodes of each level start (and n), from the root down to the leaves."""
    last = int(cuts[:, 1].max(initial=0))
    return [np.sort(np.concatenate([[0, n], cuts[cuts[:, 1] <= k, 0]])) for k in range(last + 1)]


NODES = "node string, dim int, n int, low long, high long, least long, centre binary, radius double, ids binary, labels binary, aids binary, cuts binary, width int, vecs binary"


def _pack(leaf: int):
    """Rows (node, dim, id, label, aid, vec), sorted by node, to one row for each node."""

    def node(name: str, dim: int, rows: list[tuple]) -> dict:
        x = np.frombuffer(b"".join(r[3] for r in rows), "<i4").reshape(len(rows), dim)
        order, cuts = grow(x.astype(np.float64), leaf)
        x = x[order].astype(np.float64)
        ids, labels, aids = (np.array([r[k] for r in rows], "<i8")[order] for k in (0, 1, 2))
        centre = x.mean(0)
        width = 2 if not x.size or np.abs(x).max() < 1 << 15 else 4
        return {
            "node": name, "dim": dim, "n": len(rows), "low": int(labels.min()), "high": int(labels.max()), "least": int(ids.min()), "centre": centre.astype("<f8").tobytes(), "radius": float(np.sqrt(((x - centre) ** 2).sum(1).max())),
            "ids": ids.tobytes(), "labels": labels.tobytes(), "aids": aids.tobytes(), "cuts": cuts.tobytes(), "width": width, "vecs": x.astype(f"<i{width}").tobytes(),
        }

    def run(batches):
        held, now = [], None
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        schema = pa.schema([(c.split()[0], t) for c, t in zip(NODES.split(", "), kinds, strict=True)])
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] != now:
                    if held:
                        yield pa.RecordBatch.from_pylist([node(*now, held)], schema)
                    held, now = [], row[:2]
                held.append(row[2:])
        if held:
            yield pa.RecordBatch.from_pylist([node(*now, held)], schema)

    return run


def _sized(n: int, rule: tuple[float, int, int]) -> int:
    return min(rule[2], max(rule[1], round(rule[0] * math.sqrt(n))))


def _in_nodes(rows: DataFrame, size: int, count: int) -> DataFrame:
    """rows with ``aid`` (its place in the order) and ``node``: every ``size`` consecutive rows of one length."""
    spark = rows.sparkSession
    key = ["dim", "label", "leaf", "row"]
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(count / RANGE_ROWS))
    ordered = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("place", F.monotonically_increasing_id())
    ordered = written(ordered.withColumn("range", F.shiftright("place", 33)), "ordered")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ahead = ordered.groupBy("range").agg(F.count("*").alias("n"))  # a row for each partition
    ahead = written(ahead.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")), "ahead")
    if parts <= BROADCAST_ROWS:
        ahead = F.broadcast(ahead)
    aid = F.col("ahead") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(ahead, "range").withColumn("aid", aid).withColumn("node", F.concat_ws("-", F.floor(F.col("aid") / size).cast("string"), "dim"))


def _packed(rows: DataFrame, leaf: int, name: str, nodes: int) -> DataFrame:
    nodes = max(rows.sparkSession.sparkContext.defaultParallelism, nodes)
    dealt = rows.select("node", "dim", "id", "label", "aid", "vec").repartition(nodes, "node").sortWithinPartitions("node")
    return written(dealt.mapInArrow(_pack(leaf), NODES), name)


def _bounded(batches):
    """mid and spread of the inner products of two nodes: all of them lie in mid -+ spread."""
    for b in batches:
        a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<f8") for k in ("a", "c"))
        dims = np.asarray(b.column("dim")).astype(np.int64)
        rows = np.repeat(np.arange(len(dims)), dims)
        dot = lambda x, y: np.bincount(rows, x * y, len(dims)) if len(rows) else np.zeros(len(dims))  # noqa: E731, B023
        ra, rc = (np.asarray(b.column(k)) for k in ("ra", "rc"))
        mid, na, nc = dot(a, c), np.sqrt(dot(a, a)), np.sqrt(dot(c, c))
        spread = (ra * nc + rc * na + ra * rc) * (1 + 1e-9) + np.abs(mid) * 1e-9 + 1e-6
        yield pa.RecordBatch.from_arrays([b.column("anode"), b.column("cnode"), pa.array(mid), pa.array(spread)], ["anode", "cnode", "mid", "spread"])


def _node_pairs(anchors: DataFrame, nodes: DataFrame, same: bool, count: int) -> DataFrame:
    """(anode, cnode, mid, spread, rank): pairs of nodes whose labels can meet; rank is the place among the anchor node's pairs, best first.

    Summaries only. Candidate nodes are dealt to salts and anchor nodes visit each, so no length is a hot key."""
    salts = max(1, math.ceil(count / SUMMARIES))
    side = lambda df, k: df.select(F.col("node").alias(f"{k}node"), "dim", F.col("centre").alias(k), F.col("radius").alias(f"r{k}"), F.col("low").alias(f"{k}low"), F.col("high").alias(f"{k}high"))
    a = side(anchors, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    c = side(nodes, "c").withColumn("salt", F.pmod(F.hash("cnode"), F.lit(salts)))
    meet = (F.col("alow") <= F.col("chigh")) & (F.col("clow") <= F.col("ahigh")) if same else ~((F.col("alow") == F.col("ahigh")) & (F.col("clow") == F.col("chigh")) & (F.col("alow") == F.col("clow")))
    pairs = a.join(c, ["dim", "salt"]).where(meet).select("anode", "cnode", "dim", "a", "c", "ra", "rc")
    bounds = pairs.mapInArrow(_bounded, "anode string, cnode string, mid double, spread double")
    return written(bounds.withColumn("rank", F.row_number().over(W.partitionBy("anode").orderBy(F.desc("mid"), "cnode"))), "nodepairs")


class _Tree:
    """Centres and radii of a node's lower levels, for rows that are in tree order."""

    def __init__(self, x: np.ndarray, cuts: np.ndarray):
        self.x, self.levels, self.stats = x, levels_of(cuts, len(x)), []
        for level in self.levels:
            at, sizes = level[:-1], np.diff(level)
            centre = np.add.reduceat(x, at, axis=0) / sizes[:, None] if x.shape[1] else np.zeros((len(at), 0))
            off = ((x - np.repeat(centre, sizes, axis=0)) ** 2).sum(1)
            self.stats.append((centre, np.sqrt(np.maximum.reduceat(off, at)), np.sqrt((centre**2).sum(1))))

    def below(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of the next level inside each of ``nodes``, and how many each has: one, or two where it is cut."""
        first = np.searchsorted(self.levels[level + 1], self.levels[level])
        counts = np.diff(first)[nodes]
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(first[nodes], counts) + inside, counts


class Cell:
    """One anchor node against one candidate node: the lower part of the search."""

    def __init__(self, dim: int, anchors: tuple, candidates: tuple, windows: np.ndarray, k: int, same: bool):
        """anchors and candidates: (ids, labels, vectors, cuts); windows: rows (place of the anchor, w, lo, hi, t, tid)."""
        (self.a_ids, self.a_labels, a, a_cuts), (self.c_ids, self.c_labels, c, c_cuts) = anchors, candidates
        self.k, self.same = k, same
        most = lambda x: int(np.abs(x).max(initial=0))
        kind = np.float64 if dim * most(a) * most(c) < 1 << 53 else np.int64  # every sum of products is exact
        self.a, self.c = a.astype(kind), c.astype(kind)
        self.trees = _Tree(a.astype(np.float64), a_cuts), _Tree(c.astype(np.float64), c_cuts)
        n, w = len(a), int(windows[:, 1].max(initial=0)) + 1
        self.lo, self.hi = np.ones((n, w), np.int64), np.zeros((n, w), np.int64)
        self.t, self.tid = np.full((n, w), NONE), np.zeros((n, w), np.int64)
        for at, col in ((self.lo, 2), (self.hi, 3), (self.t, 4), (self.tid, 5)):
            at[windows[:, 0], windows[:, 1]] = windows[:, col]
        self.top = [np.zeros((0,), np.int64) for _ in range(3)]  # question (row * w + window), score, id

    def floors(self) -> np.ndarray:
        """The least score that any question of a row can still use."""
        low = np.where(self.lo <= self.hi, np.maximum(self.lo, self.t), np.iinfo(np.int64).max)
        return low.min(1).astype(np.float64)

    def leaf_pairs(self):
        """(anchor leaf, candidate leaf, mid, spread) left by the intervals of all levels, best first."""
        (ta, tc), floor = self.trees, self.floors()
        ceil = np.where(self.lo <= self.hi, self.hi, NONE).max(1).astype(np.float64)
        i = j = np.zeros(1, np.int64)
        la = lc = 0
        while True:
            (a, ra, na), (c, rc, nc) = ta.stats[la], tc.stats[lc]
            at = ta.levels[la][:-1]
            low, high = np.minimum.reduceat(floor, at), np.maximum.reduceat(ceil, at)
            mid = np.einsum("ij,ij->i", a[i], c[j])
            spread = (ra[i] * nc[j] + rc[j] * na[i] + ra[i] * rc[j]) * (1 + 1e-9) + np.abs(mid) * 1e-9 + 1e-6
            open_ = (mid + spread >= low[i]) & (mid - spread <= high[i])
            i, j, mid, spread = i[open_], j[open_], mid[open_], spread[open_]
            if not len(i) or (la + 1 == len(ta.levels) and lc + 1 == len(tc.levels)):
                order = np.argsort(-mid, kind="stable")
                return i[order], j[order], mid[order], spread[order]
            if la + 1 < len(ta.levels):
                i, counts = ta.below(la, i)
                la, j = la + 1, np.repeat(j, counts)
            if lc + 1 < len(tc.levels):
                j, counts = tc.below(lc, j)
                lc, i = lc + 1, np.repeat(i, counts)

    def merge(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """The k best of each question, with new ones; thresholds follow the k-th."""
        touched = np.isin(self.top[0], q)
        q, score, ids = (np.concatenate([x[touched], y]) for x, y in zip(self.top, (q, score, ids), strict=True))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        start = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        kth = place == self.k - 1
        self.t.ravel()[q[kth]], self.tid.ravel()[q[kth]] = score[kth], ids[kth]
        keep = place < self.k
        self.top = [np.concatenate([x[~touched], y[keep]]) for x, y in zip(self.top, (q, score, ids), strict=True)]

    def search(self) -> tuple[np.ndarray, ...]:
        """(place of the anchor, w, id, score) of what beats the questions' thresholds, k of each at most."""
        a_at, c_at = self.trees[0].levels[-1], self.trees[1].levels[-1]
        w = self.lo.shape[1]
        for i, j, mid, spread in zip(*self.leaf_pairs(), strict=True):
            a, c = slice(a_at[i], a_at[i + 1]), slice(c_at[j], c_at[j + 1])
            lo, hi, t, tid = self.lo[a], self.hi[a], self.t[a], self.tid[a]
            least = np.where(lo <= hi, np.maximum(lo, t), np.iinfo(np.int64).max)
            if mid + spread < float(least.min()):
                continue
            scores = np.rint(self.a[a] @ self.c[c].T).astype(np.int64)
            may = self.a_ids[a][:, None] != self.c_ids[c][None, :]
            may &= (self.a_labels[a][:, None] == self.c_labels[c][None, :]) == self.same
            may &= scores >= least.min(1)[:, None]
            row, col = np.nonzero(may)
            if not len(row):
                continue
            score, ids = scores[row, col], self.c_ids[c][col]
            hits = []
            for k in range(w):
                ok = (score >= lo[row, k]) & (score <= hi[row, k]) & ((score > t[row, k]) | ((score == t[row, k]) & (ids < tid[row, k])))
                hits.append(((row[ok] + a.start) * w + k, score[ok], ids[ok]))
            q, score, ids = (np.concatenate(x) for x in zip(*hits, strict=True))
            if len(q):
                self.merge(q, score, ids)
        q, score, ids = self.top
        return q // w, q % w, ids, score


def _cells(k: int, same: bool):
    def run(batches):
        i8 = lambda x: np.frombuffer(x, "<i8")
        for b in batches:
            for r in b.to_pylist():
                side = lambda s: (i8(r[f"{s}ids"]), i8(r[f"{s}labels"]), np.frombuffer(r[f"{s}vecs"], f"<i{r[f'{s}width']}").reshape(r[f"{s}n"], r["dim"]), i8(r[f"{s}cuts"]).reshape(-1, 2))  # noqa: E731, B023
                aids, windows = i8(r["aaids"]), i8(r["windows"]).reshape(-1, 6).copy()
                by = np.argsort(aids)
                windows[:, 0] = by[np.searchsorted(aids, windows[:, 0], sorter=by)]
                at, w, ids, score = Cell(r["dim"], side("a"), side("c"), windows, k, same).search()
                yield pa.RecordBatch.from_arrays([pa.array(aids[at]), pa.array(w.astype(np.int32)), pa.array(ids), pa.array(score)], ["aid", "w", "id", "score"])

    return run


def _pack_windows(batches):
    """Rows (node, aid, w, lo, hi, t, tid), sorted by node, to (node, windows, floor, ceil)."""
    held, now = [], None

    def row():
        x = np.array(held, "<i8")
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([x.tobytes()], pa.binary()), pa.array([float(np.maximum(x[:, 2], x[:, 4]).min())]), pa.array([float(x[:, 3].max())])], ["node", "windows", "floor", "ceil"])

    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[0] != now:
                if held:
                    yield row()
                held, now = [], r[0]
            held.append(r[1:])
    if held:
        yield row()


def search(questions: DataFrame, anchors: DataFrame, nodes: DataFrame, count: int, k: int, same: bool) -> DataFrame:
    """questions(node, aid, w, lo, hi) -> (aid, w, id, score, rank): for each the first k candidates of the same label, or of another, with a score in the window.

    anchors, nodes: the packed nodes of both sides; count: how many nodes the candidates have."""
    spark = questions.sparkSession
    pairs = _node_pairs(anchors, nodes, same, count)
    last = pairs.agg(F.max("rank")).first()[0] or 0
    best = W.partitionBy("aid", "w").orderBy(F.desc("score"), "id")
    top = None
    start, end = 0, FIRST
    renamed = lambda df, s: df.select(*[F.col(c).alias(f"{s}{c}") for c in ("node", "n", "ids", "labels", "aids", "cuts", "width", "vecs")])
    while start < last:
        now = questions
        if top is None:
            now = now.select("node", "aid", "w", "lo", "hi", F.lit(NONE).alias("t"), F.lit(0).cast("long").alias("tid"))
        else:
            kth = top.where(F.col("rank") == k).select("aid", "w", F.col("score").alias("t"), F.col("id").alias("tid"))
            now = now.join(kth, ["aid", "w"], "left").select("node", "aid", "w", "lo", "hi", F.coalesce("t", F.lit(NONE)).alias("t"), F.coalesce("tid", F.lit(0)).alias("tid"))
        now = now.select("node", "aid", F.col("w").cast("long").alias("w"), "lo", "hi", "t", "tid")
        windows = written(now.repartition("node").sortWithinPartitions("node").mapInArrow(_pack_windows, "node string, windows binary, floor double, ceil double"), "windows")
        ours = pairs.where((F.col("rank") > start) & (F.col("rank") <= end))
        todo = ours.join(windows.select(F.col("node").alias("anode"), "floor", "ceil"), "anode")
        todo = written(todo.where((F.col("mid") + F.col("spread") >= F.col("floor")) & (F.col("mid") - F.col("spread") <= F.col("ceil"))).select("anode", "cnode"), "todo")
        items = todo.count()
        if items:
            dealt = max(1, min(items, max(4 * spark.sparkContext.defaultParallelism, math.ceil(items / 16))))
            cells = todo.join(renamed(anchors, "a").join(windows.select(F.col("node").alias("anode"), "windows"), "anode"), "anode")
            cells = cells.join(renamed(nodes, "c").join(nodes.select(F.col("node").alias("cnode"), "dim"), "cnode"), "cnode")
            found = cells.repartition(dealt, "anode", "cnode").mapInArrow(_cells(k, same), FOUND)
            every = found if top is None else top.drop("rank").unionByName(found)
            top = written(every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "top")
        start, end = end, end * GROWTH
    return top if top is not None else spark.createDataFrame([], FOUND + ", rank int")


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, depth: int = DEPTH, node: int | None = None, anchor_node: int | None = None) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` is a condition on the rows. A negative's score lies between ``low`` and ``high`` percent of its positive's."""
    spark = vectors.sparkSession
    small_batches(spark)
    emb = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), emb.alias("emb"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("emb"))).withColumn("dim", F.size("emb"))
    by: dict[int, list] = {}
    for r in rows.select("emb").orderBy(F.xxhash64(F.lit(SEED), "emb")).limit(SAMPLE).collect():
        by.setdefault(len(r.emb), []).append(r.emb)
    trees = {d: fit_tree(whole_numbers(np.array(x), scale).astype(np.float32), depth) for d, x in by.items() if d}
    run, schema = _numbers(trees, scale)
    rows = written(rows.mapInArrow(run, schema).withColumn("row", F.xxhash64("id", "vec", F.monotonically_increasing_id())), "numbers")
    count = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).first()
    size, anchor_size = node or _sized(count.n, NODE), anchor_node or _sized(count.n, ANCHOR_NODE)
    dims = max(1, len(by))
    nodes = _packed(_in_nodes(rows, size, count.n), LEAF, "nodes", math.ceil(count.n / size))
    own = written(_in_nodes(rows.where("anchor"), anchor_size, count.a), "anchors")
    anchors = _packed(own, ANCHOR_LEAF, "anchornodes", math.ceil(count.a / anchor_size))
    summaries = math.ceil(count.n / size) + dims
    question = own.select("node", "aid", F.lit(0).alias("w"), F.lit(NONE + 1).alias("lo"), F.lit(-NONE - 1).alias("hi"))
    found = search(question, anchors, nodes, summaries, positives, True)
    # the share of a score, exact in decimals, rounded into the window
    share = lambda percent: F.col("score").cast("decimal(20,0)") * F.lit(percent).cast("decimal(10,0)") / F.lit(100).cast("decimal(3,0)")
    question = found.select("aid", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.ceil(share(low)).cast("long").alias("lo"), F.floor(share(high)).cast("long").alias("hi"))
    question = written(question.where("lo <= hi").join(own.select("aid", "node", F.col("id").alias("anchor_id")), "aid"), "questions")
    out = search(question, anchors, nodes, summaries, negatives, False)
    out = out.join(question, ["aid", "w"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def digest(vectors: DataFrame, **how) -> DataFrame:
    """The query's labels: where vec_id is divisible by 7, label first becomes (label + 1) % 10; anchors are the rows divisible by 50."""
    vec_id = F.col("vec_id").cast("long")
    changed = F.when(vec_id % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(vectors.select("vec_id", "embedding", changed.alias("label")), vec_id % ANCHOR_EVERY == 0, **how)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same
), n AS (
  SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, r ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
  WHERE r <= 5
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
