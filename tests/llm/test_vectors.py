"""Embedding near-dedup and nearest neighbours against brute force."""

import numpy as np
import pytest

from waymark.llm import ann, embedding_dedup


def clustered(n=600, dim=24, seed=1):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n // 8, dim))
    x = np.concatenate([centres + 0.18 * k / 7 * r.standard_normal(centres.shape) for k in range(8)])[:n]
    x[5] = x[6] = x[7]
    return x.astype(np.float32)


def frame(spark, x, labels=None, odd=True):
    rows = [(k, [float(v) for v in e], int(labels[k]) if labels is not None else k % 3, "old") for k, e in enumerate(x)]
    if odd:
        d = x.shape[1]
        nan, inf = float("nan"), float("inf")
        rows += [(9000, None, 1, ""), (9001, [0.0] * d, 1, ""), (9002, [nan] + [1.0] * (d - 1), 1, ""), (9003, [inf] * d, 1, ""), (9004, [], 1, ""), (9005, [None] + [1.0] * (d - 1), 1, ""), (9006, [float(v) for v in x[0]], None, ""), (9007, [1.0, 2.0], 1, ""), (9020, [2.0, 4.0], 1, "")]
        rows += [rows[3], (None, rows[4][1], rows[4][2], "")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")


@pytest.mark.parametrize("block", [None, 16])
def test_near_vectors(spark, block):
    x = clustered()
    df = frame(spark, x)
    rows = [(r.vec_id if r.vec_id is not None else 2**63 - 1, r.embedding, r.label) for r in df.collect()]

    def ok(e, lab):
        return bool(e) and lab is not None and None not in e and np.isfinite(e).all() and any(e)

    good = [ok(e, lab) for _, e, lab in rows]
    unit = [np.array(e, float) / np.linalg.norm(np.array(e, float)) if g else None for g, (_, e, _) in zip(good, rows, strict=True)]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                link[i, j] = link[j, i] = True
    comp = [-1] * n
    for i in sorted(range(n), key=lambda k: rows[k][0]):
        if comp[i] == -1:
            front = [i]
            while front:
                k = front.pop()
                if comp[k] == -1:
                    comp[k] = rows[i][0]
                    front += [int(j) for j in np.flatnonzero(link[k]) if comp[j] == -1]
    back = lambda v: None if v == 2**63 - 1 else v
    want = sorted([(back(rows[i][0]), int(link[i].sum()), back(comp[i]), comp[i] == rows[i][0]) for i in range(n)], key=str)
    got = sorted([tuple(r) for r in embedding_dedup.digest(df, block=block).collect()], key=str)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)
    assert got == want


def test_near_vectors_of_a_crowded_group(spark):
    """Different near copies that hold a third of the rows, and all else noise: every link counts."""
    r = np.random.default_rng(4)
    x = r.standard_normal((3000, 64))
    x[::3] = r.standard_normal(64) + 0.23 * r.standard_normal((1000, 64))
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.93
    want = link.sum(1) - 1
    assert 0.3 * 1000**2 < want.sum() < 1000**2
    df = frame(spark, x.astype(np.float32), [1] * 3000, odd=False)
    got = {row.vec_id: row for row in embedding_dedup.digest(df).collect()}
    assert [got[k].n_links for k in range(3000)] == want.tolist()


def test_reference_points_keep_apart(spark):
    """A crowd that holds most rows holds no more than a few of the points."""
    r = np.random.default_rng(5)
    x = np.vstack([r.standard_normal(32) + 0.1 * r.standard_normal((900, 32)), r.standard_normal((100, 32))]).astype("<f4")
    df = spark.createDataFrame([(bytearray(v.tobytes()),) for v in x], "emb binary")
    points = embedding_dedup.points_for(df, 400, "<f4")[128]
    near = points @ points.T - np.eye(len(points))
    assert near.max() <= embedding_dedup.APART + 1e-6 and 20 < len(points) <= 101


def test_near_vectors_empty(spark):
    df = frame(spark, clustered(16)).limit(0)
    assert embedding_dedup.digest(df).count() == 0
    assert embedding_dedup.deduplicate(frame(spark, clustered(40), [1] * 40)).where("vec_id = 6").count() == 0


@pytest.mark.parametrize("n,block,scale", [(600, 1024, False), (2500, 400, False), (900, 300, True)])
def test_neighbours(spark, n, block, scale):
    x = clustered(n)
    if scale:
        x *= np.random.default_rng(2).uniform(0.3, 2.0, (len(x), 1)).astype(np.float32)
    got = {}
    for r in ann.digest(frame(spark, x), block=block).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    vectors = {k: e.astype(float) for k, e in enumerate(x)} | {9006: x[0].astype(float)}
    hits = total = 0
    for q in [k for k in vectors if k % 20 == 0]:
        scores = sorted(((-float(vectors[q] @ e), k) for k, e in vectors.items() if k != q))[:20]
        mine = got[q]
        assert sorted(mine) == list(range(1, 21))
        order = [(-s, v) for v, s in (mine[k] for k in range(1, 21))]
        assert order == sorted(order)
        assert all(abs(s - vectors[q] @ vectors[v]) < 1e-9 for v, s in mine.values())
        total += 20
        hits += len({v for v, _ in mine.values()} & {k for _, k in scores})
    assert hits >= 0.95 * total
    assert 9001 not in got and got[9020] == {1: (9007, 10.0)}  # the two vectors of length 2 find each other


def test_neighbours_of_few(spark):
    df = frame(spark, clustered(16), odd=False)
    out = ann.digest(df).collect()
    assert {r.query_id for r in out} == {0} and len(out) == 15
    assert ann.digest(df.limit(0)).count() == 0
    one = df.where("vec_id = 0")
    assert ann.digest(one).count() == 0


def test_equal_vectors_rank_by_id(spark):
    x = np.repeat(clustered(40)[:2], 30, axis=0)
    out = [r for r in ann.digest(frame(spark, x, odd=False)).collect() if r.query_id == 20]
    assert [r.vec_id for r in sorted(out, key=lambda r: r["rank"])] == [k for k in range(21) if k != 20]


def test_parts_of_a_neighbourhood_meet():
    """Members in different parts are each other's candidates, as all are in one part."""
    import pyarrow as pa

    x = clustered(48)
    rows = pa.RecordBatch.from_arrays([pa.array([7] * 48), pa.array(range(48)), pa.array(ann.encode(x), pa.binary()), pa.array([-9.0] * 48, pa.float32()), pa.array([True] * 48)], ["grp", "member", "code", "worst", "fresh"])
    lists = lambda hub: {p for b in ann._local_join(47, hub)([rows]) for p in zip(*(a.tolist() for a in ann._flat(b)[:2]), strict=True)}
    assert lists(10) == lists(48) and len(lists(48)) == 48 * 47
