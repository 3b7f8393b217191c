"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search on it.

Build: equal vectors are one node. A node's list starts with its best neighbours inside a few
random blocks of bounded size. Each round then joins lists with their reverse: the members of
a node's neighbourhood are each other's candidates where one of the two edges is new, and what
beats a list's last entry goes there. Rounds end when few entries change.
Search: every query walks the graph. A round expands its best unexpanded nodes, joins them
with the adjacency table, and keeps the best ``BEAM``, until no beam holds an unexpanded node. The best are scored again in double
precision on the original vectors.

Inner product is made a cosine by one more component, sqrt(max norm^2 - norm^2). Graph and walk
use 8-bit codes of these vectors; codes only choose candidates. A neighbourhood is read as a stream
and joined in parts of ``HUB`` members, each with itself and with all before it, so matrices stay
bounded and no pair is left out; only the codes of a popular vector's neighbourhood are held. (Equal vectors being one node, how many lists can name a node is bounded by geometry.)

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no
part, as query or candidate. Vectors of different length have no inner product: each length has its
own index and its own candidates. Fewer candidates than ``k``: all that were found. Equal scores go by vec_id. A null vec_id takes no part. Rows that share a vec_id are one vector for the
rule that a query never finds itself. An empty table gives an empty result. Extra columns are
ignored. Recall against brute force is measured in tests/llm and noted in the README.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, written
from .embedding_dedup import packed, usable

TOP, DEGREE, BLOCK, BLOCKINGS, HUB = 20, 32, 1024, 3, 256
MAX_ROUNDS, SETTLED = 12, 0.05  # rounds of descent; the share of changed entries at which they end
BEAM, EXPAND, RESCORED = 256, 64, 128
QUERY_EVERY = 20


def encode(x: np.ndarray) -> list[bytes]:
    """8-bit codes of the rows of x, each with its scale in front."""
    scale = np.maximum(np.abs(x).max(1), 1e-30).astype(np.float32) / np.float32(127)
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return [s.tobytes() + c.tobytes() for s, c in zip(scale, codes, strict=True)]


def decode(blob: bytes, rows: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.int8).reshape(rows, -1)
    return raw[:, 4:].astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def norms(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)
    most = np.abs(x).max(1)
    return x, most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def _coder(largest: float):
    def run(batches):
        """(cid, code, qcode): the code as a candidate, and as a query, whose last component is 0."""
        for b in batches:
            if not b.num_rows:
                continue
            x, n = norms(b.column(1).to_pylist())
            part = n / largest
            own = np.hstack([x / largest, np.sqrt(np.maximum(0.0, 1 - part * part))[:, None]])
            ask = np.hstack([x / n[:, None], np.zeros((len(x), 1))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encode(own), pa.binary()), pa.array(encode(ask), pa.binary())], ["cid", "code", "qcode"])

    return run


def _best(owner, ids, sims, fresh, degree: int):
    """Per owner the ``degree`` best different ids, sorted; an id seen twice is fresh only if it is so both times."""
    order = np.lexsort((fresh, ids, owner))
    owner, ids, sims, fresh = owner[order], ids[order], sims[order], fresh[order]
    once = np.append(True, (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])) if len(owner) else np.zeros(0, bool)
    owner, ids, sims, fresh = owner[once], ids[once], sims[once], fresh[once]
    order = np.lexsort((ids, -sims, owner))
    owner, ids, sims, fresh = owner[order], ids[order], sims[order], fresh[order]
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, int)
    place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
    keep = place < degree
    return owner[keep], ids[keep], sims[keep], fresh[keep]


#: A node's list, best first; ``code`` is the node's own code (in a beam: the query's), null in rows of mere candidates.
LIST = "cid long, ids binary, sims binary, fresh binary, code binary"


def _lists(owner, ids, sims, fresh, codes: dict | None = None) -> pa.RecordBatch:
    """One row for each owner; arrays come sorted by owner."""
    if not len(owner):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), *(pa.array([], pa.binary()),) * 4], ["cid", "ids", "sims", "fresh", "code"])
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, int)
    ends = np.append(starts[1:], len(owner)).astype(int)
    cut = lambda a, t: pa.array([a[s:e].astype(t).tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary())
    own = [(codes or {}).get(c) for c in owner[starts].tolist()]
    return pa.RecordBatch.from_arrays([pa.array(owner[starts].astype(np.int64)), cut(ids, "<i8"), cut(sims, "<f4"), cut(fresh, "i1"), pa.array(own, pa.binary())], ["cid", "ids", "sims", "fresh", "code"])


def _flat(batch) -> tuple:
    """(owner, ids, sims, fresh) of the lists in a batch."""
    blobs = batch.column(1).to_pylist()
    sizes = np.array([len(x) // 8 for x in blobs], np.int64)
    join = lambda k, t: np.frombuffer(b"".join(batch.column(k).to_pylist()), t)
    return np.repeat(batch.column(0).to_numpy(), sizes), np.frombuffer(b"".join(blobs), "<i8"), join(2, "<f4"), join(3, "i1")


def _merger(degree: int):
    def run(batches):
        """Lists of one owner into one. Rows come sorted by cid; the last owner of a batch waits for the next batch."""
        wait, codes = None, {}
        for b in batches:
            codes |= {c: x for c, x in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True) if x is not None}
            now = _flat(b)
            if wait is not None:
                now = tuple(np.concatenate(x) for x in zip(wait, now, strict=True))
            if not len(now[0]):
                continue
            now = _best(*now, degree)
            end = int(now[0][-1])
            last = now[0] == end
            wait = tuple(x[last] for x in now)
            if not last.all():
                yield _lists(*(x[~last] for x in now), codes)
            codes = {c: x for c, x in codes.items() if c == end}
        if wait is not None:
            yield _lists(*wait, codes)

    return run


def merged(lists: DataFrame, degree: int) -> DataFrame:
    return lists.repartition("cid").sortWithinPartitions("cid").mapInArrow(_merger(degree), LIST)


def _groups(batches, width: int, most: int = 1 << 60):
    """Runs of rows with equal first ``width`` columns, in parts of ``most`` rows."""
    held, now = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:width] != now or len(held) >= most:
                if held:
                    yield now, held
                held, now = [], row[:width]
            held.append(row[width:])
    if held:
        yield now, held


def _gathered(found, degree: int, limit: int = 400_000):
    """Candidate edges (owner, id, sim) of many groups, combined before they are shuffled."""
    parts, size = [], 0
    for part in found:
        parts.append(part)
        size += len(part[0])
        if size > limit:
            yield _combined(parts, degree)
            parts, size = [], 0
    if parts:
        yield _combined(parts, degree)


def _combined(parts, degree):
    owner, ids, sims = (np.concatenate([p[k] for p in parts]) for k in range(3))
    return _lists(*_best(owner, ids, sims, np.ones(len(owner), np.int8), degree))


def _block_lists(degree: int):
    def one(rows):
        cid, x = np.array([r[0] for r in rows]), decode(b"".join(r[1] for r in rows), len(rows))
        s = x @ x.T
        np.fill_diagonal(s, -9)
        k = min(degree, len(rows) - 1)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((len(rows), 0), int)
        return np.repeat(cid, k), cid[top].ravel(), np.take_along_axis(s, top, 1).ravel()

    def run(batches):
        for _, rows in _groups(batches, 2):
            owner, ids, sims = one(rows)
            yield _lists(*_best(owner, ids, sims, np.ones(len(owner), np.int8), degree), {r[0]: r[1] for r in rows})

    return run


def _local_join(degree: int, hub: int):
    def one(rows):
        """rows: (member, code, threshold, fresh edge) of one neighbourhood."""
        cid, fresh = np.array([r[0] for r in rows]), np.array([r[3] for r in rows], bool)
        cid, at, where = np.unique(cid, return_index=True, return_inverse=True)
        new = np.zeros(len(cid), bool)
        np.logical_or.at(new, where, fresh)
        if not new.any() or len(cid) < 2:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.float32),)
        x = decode(b"".join(rows[i][1] for i in at), len(at))
        worst = np.array([rows[i][2] for i in at], np.float32)
        s = x @ x.T
        np.fill_diagonal(s, -9)
        a, b = np.nonzero((s > worst[:, None]) & (new[:, None] | new[None, :]))
        return cid[a], cid[b], s[a, b]

    def joined(batches):
        """Each part of a neighbourhood, and each part with every earlier one."""
        now, parts = None, []
        for group, rows in _groups(batches, 1, hub):
            if group != now:
                now, parts = group, []
            yield one(rows)
            for before in parts:
                yield one(before + rows)
            parts.append(rows)

    def run(batches):
        yield from _gathered(joined(batches), degree)

    return run


def _worst(sims: bytes, degree: int) -> float:
    return float(np.frombuffer(sims[-4:], "<f4")[0]) if len(sims) >= 4 * degree else -9.0


def _spread(degree: int):
    def run(batches):
        """(node, neighbour, fresh, code, worst): one row for each entry of a list."""
        for b in batches:
            owner, ids, _, fresh = _flat(b)
            where = pa.array(np.repeat(np.arange(b.num_rows), [len(x) // 8 for x in b.column(1).to_pylist()]))
            worst = pa.array([_worst(x, degree) for x in b.column(2).to_pylist()], pa.float32())
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(ids), pa.array(fresh.astype(bool)), b.column(4).take(where), worst.take(where)], ["node", "neighbour", "fresh", "code", "worst"])

    return run


def _heads(degree: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), pa.array([_worst(x, degree) for x in b.column(2).to_pylist()], pa.float32())], ["c", "ncode", "nworst"])

    return run


def _neighbourhoods(graph: DataFrame, degree: int) -> DataFrame:
    """(grp, member, code, worst, fresh): each node's list and reverse list, with the members' codes."""
    edges = graph.mapInArrow(_spread(degree), "node long, neighbour long, fresh boolean, code binary, worst float")
    nodes = graph.mapInArrow(_heads(degree), "c long, ncode binary, nworst float")
    both = edges.join(nodes.hint("merge"), F.col("neighbour") == F.col("c"))
    entry = lambda g, m, c, w: F.struct(F.col(g).alias("grp"), F.col(m).alias("member"), F.col(c).alias("code"), F.col(w).alias("worst"))
    return both.select(F.explode(F.array(entry("node", "neighbour", "ncode", "nworst"), entry("neighbour", "node", "code", "worst"))).alias("e"), "fresh").select("e.*", "fresh")


def build_graph(codes: DataFrame, n: int, degree: int = DEGREE, block: int = BLOCK, blockings: int = BLOCKINGS, rounds: int = MAX_ROUNDS, settled: float = SETTLED, hub: int = HUB) -> DataFrame:
    """codes(cid, code) -> lists (cid, ids, sims, fresh), best first."""
    blocks = max(1, math.ceil(n / block))
    tries = blockings if blocks > 1 else 1
    spots = F.array(*[F.struct(F.lit(r).alias("r"), F.pmod(F.xxhash64(F.lit(r), "cid"), F.lit(blocks)).cast("int").alias("b")) for r in range(tries)])
    dealt = codes.select("cid", "code", F.explode(spots).alias("s")).select("s.r", "s.b", "cid", "code").repartition("r", "b").sortWithinPartitions("r", "b")
    graph = written(merged(dealt.mapInArrow(_block_lists(degree), LIST), degree), "graph")
    for _ in range(rounds if blocks > 1 else 0):
        around = _neighbourhoods(graph, degree).repartition("grp").sortWithinPartitions("grp")
        found = around.mapInArrow(_local_join(degree, hub), LIST)
        stale = graph.withColumn("fresh", F.unhex(F.repeat(F.lit("00"), (F.length("ids") / 8).cast("int"))))
        graph = written(merged(stale.unionByName(found), degree), "graph")
        share = graph.select(F.sum(F.length(F.replace(F.hex("fresh"), F.lit("00"), F.lit("")))).alias("new"), F.sum(F.length("fresh") * 2).alias("all")).first()
        if not share["all"] or share["new"] / share["all"] < settled:
            break
    return graph


def _adjacency(graph: DataFrame, degree: int, hub: int, n: int) -> str:
    """A table (node, ids, codes) of lists and reverse lists, bucketed by node so that the walk never shuffles it."""

    def pack(batches):
        for group, rows in _groups(batches, 1, hub):
            cid, at = np.unique(np.array([r[0] for r in rows]), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array([group[0]]), pa.array([cid.astype("<i8").tobytes()], pa.binary()), pa.array([b"".join(rows[i][1] for i in at)], pa.binary())], ["node", "ids", "codes"])

    name, buckets = f"adjacency_{uuid.uuid4().hex[:12]}", max(12, math.ceil(n / 20_000))
    around = _neighbourhoods(graph, degree).select("grp", "member", "code").repartition(buckets, "grp").sortWithinPartitions("grp")
    table = around.mapInArrow(pack, "node long, ids binary, codes binary")
    table.write.bucketBy(buckets, "node").sortBy("node").option("compression", "uncompressed").option("path", new_path(graph.sparkSession, "adjacency")).saveAsTable(name)
    return name


def _start(beam: int):
    def run(batches):
        """The walk begins at the query's own list: rows (cid, qcode, ids, sims); fresh means not yet expanded."""
        for b in batches:
            for q, code, ids, sims in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = np.append(np.frombuffer(ids or b"", "<i8"), q)
                sim = np.append(np.frombuffer(sims or b"", "<f4"), np.float32(9))  # the query's own node comes first; it is scored in the end
                yield _lists(*_best(np.full(len(own), q), own, sim, np.ones(len(own), np.int8), beam), {q: code})

    return run


def _front(expand: int, beam: int):
    def run(batches):
        """(node, q, qcode, worst) of the best unexpanded entries of each beam."""
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for q, ids, sims, fresh, code in zip(*(c.to_pylist() for c in b.columns), strict=True):
                go = np.frombuffer(ids, "<i8")[np.flatnonzero(np.frombuffer(fresh, "i1"))[:expand]].tolist()
                for part, v in zip(out, (go, [q] * len(go), [code] * len(go), [_worst(sims, beam)] * len(go)), strict=True):
                    part.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.float32())], ["node", "q", "qcode", "worst"])

    return run


def _expanded(expand: int):
    def run(batches):
        for b in batches:
            marks = []
            for x in b.column(3).to_pylist():
                x = np.frombuffer(x, "i1").copy()
                x[np.flatnonzero(x)[:expand]] = 0
                marks.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(marks, pa.binary()), b.column(4)], ["cid", "ids", "sims", "fresh", "code"])

    return run


def _visit(beam: int):
    def score(rows):
        for q, qcode, worst, ids, codes in rows:
            ids = np.frombuffer(ids, "<i8")
            s = decode(codes, len(ids)) @ decode(qcode, 1)[0]
            keep = np.flatnonzero((s > worst) & (ids != q))
            yield np.full(len(keep), q), ids[keep], s[keep]

    def run(batches):
        yield from _gathered((found for b in batches for found in score(zip(*(c.to_pylist() for c in b.columns), strict=True))), beam)

    return run


def walk(graph: DataFrame, asks: DataFrame, n: int, degree: int = DEGREE, hub: int = HUB, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """asks(cid, qcode) -> beams (cid, ids, ..): the nodes found, best first, the query's own node in front."""
    spark = graph.sparkSession
    name = _adjacency(graph, degree, hub, n)
    beams = asks.join(graph.select("cid", "ids", "sims"), "cid", "left").select("cid", "qcode", "ids", "sims").mapInArrow(_start(beam), LIST)
    beams = written(beams, "beams")
    while beams.where(F.instr(F.hex("fresh"), "1") > 0).limit(1).count():  # a node is expanded once, so this ends
        front = beams.mapInArrow(_front(expand, beam), "node long, q long, qcode binary, worst float")
        met = front.join(spark.table(name).hint("merge"), "node").select("q", "qcode", "worst", "ids", "codes").mapInArrow(_visit(beam), LIST)
        beams = written(merged(beams.mapInArrow(_expanded(expand), LIST).unionByName(met), beam), "beams")
    spark.sql(f"drop table if exists {name}")
    return beams


def _pairs(rescored: int):
    def run(batches):
        for b in batches:
            ids = [np.frombuffer(x, "<i8")[:rescored] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), [len(x) for x in ids])), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64))], ["q", "c"])

    return run


def _score(batches):
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<f8").reshape(b.num_rows, -1) for k in (2, 3))
        s = (x * y).sum(1) if b.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], ["q", "c", "score"])


def search(vectors: DataFrame, queries=None, k: int = TOP, degree: int = DEGREE, block: int = BLOCK, rescored: int = RESCORED, **how) -> DataFrame:
    """vectors(vec_id, embedding) -> (query_id, rank, vec_id, score). queries: a condition on vec_id, by default every 20th id."""
    vid = F.col("vec_id").cast("long")
    ask = F.col("vid") % QUERY_EVERY == 0 if queries is None else queries(F.col("vid"))
    rows = vectors.select(vid.alias("vid"), F.transform("embedding", lambda x: x.cast("double")).alias("emb")).where(F.col("vid").isNotNull() & usable(F.col("emb")))
    own = written(packed(rows).withColumn("dim", (F.length("emb") / 8).cast("int")), "vectors")
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in own.select("dim").distinct().orderBy("dim").collect():  # an inner product needs two of one length: an index for each
        out = out.unionByName(_search(own.where(F.col("dim") == r.dim).drop("dim"), ask, k, degree, block, rescored, **how))
    return out


def _search(own: DataFrame, ask, k: int, degree: int, block: int, rescored: int, **how) -> DataFrame:
    """search over own(vid, emb), vectors of one length."""
    # of equal vectors only the k + 1 smallest ids can ever be ranked
    ids = own.distinct().withColumn("r", F.row_number().over(W.partitionBy("emb").orderBy("vid"))).where(F.col("r") <= k + 1)
    nodes = ids.groupBy("emb").agg(F.sort_array(F.collect_list("vid")).alias("members"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("cid"), "emb", "members"), "nodes")

    def largest(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([norms(b.column(0).to_pylist())[1].max()] if b.num_rows else [], pa.float64())], ["m"])

    stats = nodes.select("emb").mapInArrow(largest, "m double").agg(F.max("m").alias("m")).first()
    n = nodes.count()
    codes = written(nodes.select("cid", "emb").mapInArrow(_coder(stats.m), "cid long, code binary, qcode binary"), "codes")
    graph = build_graph(codes, n, degree, block)
    asked = own.where(ask).distinct().join(nodes.select("cid", "emb"), "emb").select("vid", "cid")
    asked = written(asked, "asked")
    asks = codes.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "qcode")
    beams = walk(graph, asks, n, degree, **how)
    pairs = beams.select("cid", "ids").mapInArrow(_pairs(rescored), "q long, c long")
    exact = nodes.select("cid", "emb")
    scored = pairs.join(exact.select(F.col("cid").alias("q"), F.col("emb").alias("x")), "q").join(exact.select(F.col("cid").alias("c"), F.col("emb").alias("y")), "c").select("q", "c", "x", "y").mapInArrow(_score, "q long, c long, score double")
    hits = scored.join(nodes.select(F.col("cid").alias("c"), "members"), "c").join(asked.withColumnRenamed("cid", "q"), "q")
    hits = hits.select(F.col("vid").alias("query_id"), F.explode("members").alias("vec_id"), "score").where("vec_id <> query_id")
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame, **how) -> DataFrame:
    return search(vectors.select("vec_id", "embedding"), **how)
