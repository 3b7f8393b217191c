"""Embedding near-dedup by a pivot-permutation index.

Reference points are rows of the table. A vector is described by the ordered list of its
``PREFIX`` nearest ones and filed in the inverted list of each. Two vectors of a label that share at
least ``SHARED`` of them are candidates; a candidate pair counts in the first list that it shares,
where its cosine is taken in double precision on the original vectors.

Reference points are chosen from a sample of bounded size and thinned: none is nearer to
another than ``APART``. So a crowd of near copies holds one of them, not its share, and its
members are told by how they lie to the points around, where near vectors agree, not by which
members of the crowd happen to be nearest. Recall thereby depends on a pair's cosine, not on how crowded its
neighbourhood is. (If a table is one such crowd, its few points list every vector, and all are compared.)

A list longer than a block is dealt to blocks by a hash, and each pair of blocks is one cell; blocks
grow with the root of the table, so that a crowded list is shuffled less than in proportion to its square. A
cell returns sums of links and a spanning forest, never its pairs. Equal vectors of a label are one class first.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and
those with a null label, link with nothing: n_links 0, their own component, kept. Vectors of
different length never link. A null vec_id counts as the largest. Repeated rows are vectors of
their own and link with each other. Ties go to the smallest vec_id. An empty table gives an
empty result. Extra columns pass through ``deduplicate``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, components, written

THRESHOLD = 0.93
PREFIX, SHARED = 12, 2
#: Reference points: for each root of the vectors, at most, of a sample so many times as large; no two with a higher cosine than APART.
POINTS, MAX_POINTS, SAMPLE, APART, SEED = 4.0, 8192, 2, 0.5, 20_240_601
#: Vectors of a block for each root of the vectors, at least and at most.
BLOCK, MIN_BLOCK, MAX_BLOCK = 8.0, 256, 8192
#: Cosines of a matrix product nearer to the threshold than this are taken again one by one; rows of a product at a time; pairs whose lists are compared at a time.
DOUBT, ROWS, PAIRS = 1e-9, 256, 50_000


def usable(c):
    """True where a vector takes part: not null or empty, all components finite, not all zero."""
    good = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(c) > 0) & good & F.exists(c, lambda x: x != 0), F.lit(False))


def packed(vectors: DataFrame, kind: str = "<f8") -> DataFrame:
    """vectors(id, emb, ...) with emb (array of double) as little-endian binary."""
    names = vectors.columns
    schema = ", ".join(f"{n} {'binary' if n == 'emb' else t}" for n, t in vectors.dtypes)

    def run(batches):
        for b in batches:
            k = names.index("emb")
            cells = [np.asarray(v.values).astype(kind).tobytes() for v in b.column(k)]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary()) if i == k else b.column(i) for i in range(len(names))], names)

    return vectors.mapInArrow(run, schema)


def unit(blobs: list[bytes], kind: str = "<f8") -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def points_for(vectors: DataFrame, count: int, kind: str) -> dict[int, np.ndarray]:
    """Up to ``count`` reference points for each vector length, from ``SAMPLE`` times as many rows chosen by a hash."""
    rows = vectors.select("emb").orderBy(F.xxhash64(F.lit(SEED), "emb")).limit(SAMPLE * count).collect()
    by: dict[int, list[bytes]] = {}
    for r in rows:
        by.setdefault(len(r.emb), []).append(bytes(r.emb))
    points = {}
    for dim, blobs in by.items():
        x = unit(blobs, kind)
        kept = np.zeros_like(x)
        n = 0
        for row in x:
            if n < count and (n == 0 or (kept[:n] @ row).max() <= APART):
                kept[n] = row
                n += 1
        points[dim] = kept[:n].astype(np.float32)
    return points


def nearest_points(blobs: list[bytes], points: np.ndarray, prefix: int, kind: str) -> np.ndarray:
    """Each vector's nearest reference points, nearest first."""
    near = unit(blobs, kind).astype(np.float32) @ points.T
    k = min(prefix, near.shape[1])
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


def _lister(points: dict[int, np.ndarray], prefix: int, kind: str):
    names = ["label", "dim", "point", "cid", "m", "near", "emb"]

    def run(batches):
        """A row for each vector and each of its nearest points. Lengths that no sampled row has share one list."""
        for batch in batches:
            blobs = batch.column("emb").to_pylist()
            dims = np.array([len(x) for x in blobs])
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(at))
                own = points.get(dim)
                near = nearest_points([blobs[k] for k in at], own, prefix, kind) if own is not None else np.zeros((len(at), 1), np.int64)
                for s in range(0, len(at), 500):
                    near_s = near[s : s + 500]
                    where = pa.array(np.repeat(np.arange(s, s + len(near_s)), near_s.shape[1]))
                    lists = pa.array([bytes(x) for x in near_s.astype("<u2")], pa.binary()).take(pa.array(np.repeat(np.arange(len(near_s)), near_s.shape[1])))
                    take = lambda c: part.column(c).take(where)  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([take("label"), pa.array(np.full(len(where), dim, np.int32)), pa.array(near_s.ravel().astype(np.int32)), take("cid"), take("m"), lists, take("emb")], names)

    return run, "label string, dim int, point int, cid long, m long, near binary, emb binary"


def _joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """root with the classes of x and y joined, pair by pair: the smallest index of each class."""
    while True:
        a, b = root[x], root[y]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low < high
        if not apart.any():
            return root
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def _cells(threshold: float, shared: int, kind: str):
    def compare(point: int, i: int, j: int, rows: list[tuple]):
        """rows: (cid, m, near, emb, side) with side 0 for block i and 1 for block j; one side only if i = j."""
        cid, m, side = (np.array([r[k] for r in rows]) for k in (0, 1, 4))
        near = np.frombuffer(b"".join(r[2] for r in rows), "<u2").reshape(len(rows), -1).astype(np.int32)
        need = min(shared, near.shape[1])
        vec = unit([r[3] for r in rows], kind)
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if i != j else (np.arange(len(rows)),) * 2
        links, root = np.zeros(len(rows)), np.arange(len(rows))
        if not len(left) or not len(right):
            return [], [], []
        for at in range(0, len(left), ROWS):
            own = left[at : at + ROWS]
            cos = vec[own] @ vec[right].T
            maybe = cos >= threshold - DOUBT
            if i == j:
                maybe &= own[:, None] < right[None, :]
            x, y = np.nonzero(maybe)
            hit = cos[x, y] >= threshold + DOUBT
            x, y = own[x], right[y]
            doubt = np.flatnonzero(~hit)
            hit[doubt] = np.einsum("ij,ij->i", vec[x[doubt]], vec[y[doubt]]) >= threshold
            x, y = x[hit], y[hit]
            for s in range(0, len(x), PAIRS):  # candidates share enough points, and count in the first of these
                a, b = x[s : s + PAIRS], y[s : s + PAIRS]
                same = (near[a][:, :, None] == near[b][:, None, :]).any(2)
                first = np.where(same, near[a], 1 << 16).min(1)
                mine = (same.sum(1) >= need) & (first == point)
                a, b = a[mine], b[mine]
                links += np.bincount(a, m[b], len(rows)) + np.bincount(b, m[a], len(rows))
                root = _joined(root, a, b)
        some = np.flatnonzero(links)
        return cid[some].tolist(), np.rint(links[some]).astype(np.int64).tolist(), cid[root[some]].tolist()

    def run(batches):
        held: list[tuple] = []
        now = None

        def closed():
            c, n, r = compare(*now[2:], held)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64())], ["cid", "n", "root"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:5] != now:
                    if held:
                        yield closed()
                    held, now = [], row[:5]
                held.append(row[5:])
        if held:
            yield closed()

    return run, "cid long, n long, root long"


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, prefix: int = PREFIX, shared: int = SHARED, block: int | None = None) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id, n_links, component_id, kept), one row for each row."""
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"  # vectors travel as they are
    emb = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST_ID)).alias("vid"), F.col("label").cast("string").alias("label"), emb.alias("emb"))
    good = usable(F.col("emb")) & F.col("label").isNotNull()
    own = packed(rows.where(good), kind)
    classes = own.groupBy("label", "emb").agg(F.min("vid").alias("owner"), F.count("*").alias("m"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "label", "emb", "owner", "m"), "vectors")
    n = classes.count()
    block = block or min(MAX_BLOCK, max(MIN_BLOCK, round(BLOCK * math.sqrt(n))))
    points = points_for(classes, min(MAX_POINTS, max(1, round(POINTS * math.sqrt(n)))), kind)
    run, schema = _lister(points, prefix, kind)
    lists = classes.select("cid", "label", "emb", "m").mapInArrow(run, schema)
    by = ["label", "dim", "point"]
    sizes = written(lists.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "lists")
    cells = lists.join(sizes.hint("merge"), by).withColumn("home", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    seats = F.transform(every, lambda k: F.struct(F.least(k, F.col("home")).alias("i"), F.greatest(k, F.col("home")).alias("j"), (k < F.col("home")).cast("int").alias("side")))
    cells = cells.withColumn("c", F.explode(seats)).select(*by, F.col("c.i").alias("i"), F.col("c.j").alias("j"), "cid", "m", "near", "emb", F.col("c.side").alias("side"))
    key = [*by, "i", "j"]
    run, schema = _cells(threshold, shared, kind)
    found = written(cells.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema), "cells")
    links = found.groupBy("cid").agg(F.sum("n").alias("n"))
    comps = components(found.select(F.col("cid").alias("src"), F.col("root").alias("dst")))
    place = classes.join(links, "cid", "left").join(comps.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = place.groupBy("component").agg(F.min("owner").alias("least"))
    place = place.join(least, "component").select("label", "emb", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "least")
    linked = own.join(place, ["label", "emb"]).select("vid", "n_links", F.col("least").alias("component"))
    alone = rows.where(~good).select("vid", F.lit(0).cast("long").alias("n_links"), F.col("vid").alias("component"))
    out = linked.unionByName(alone)
    return out.select(F.nullif(F.col("vid"), F.lit(LAST_ID)).alias("vec_id"), "n_links", F.nullif(F.col("component"), F.lit(LAST_ID)).alias("component_id"), (F.col("vid") == F.col("component")).alias("kept"))


def deduplicate(vectors: DataFrame, **how) -> DataFrame:
    """vectors without those that have a near duplicate of smaller vec_id in their component."""
    kept = near_duplicates(vectors, **how).where("kept").select(F.coalesce("vec_id", F.lit(LAST_ID)).alias("__kept")).distinct()
    return vectors.join(kept, F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST_ID)) == F.col("__kept"), "left_semi")


def digest(vectors: DataFrame, **how) -> DataFrame:
    return near_duplicates(vectors.select("vec_id", "embedding", "label"), **how)


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), g AS (
  SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (
  SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x
), n AS (
  SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x
)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, component_id, component_id = v.vec_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
