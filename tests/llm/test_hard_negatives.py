"""Hard negatives against brute force; the bounds of nodes; what pruning skips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import hard_negatives as hn


def clustered(n=900, dim=16, seed=1, spread=0.5):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, dim))
    x = centres[r.integers(0, 12, n)] + spread * r.standard_normal((n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x, labels, odd=True):
    rows = [(k, [float(v) for v in e], int(lab), k) for k, (e, lab) in enumerate(zip(x, labels, strict=True))]
    if odd:
        d, nan, inf = x.shape[1], float("nan"), float("inf")
        rows += [(9000, None, 1, 0), (9050, [nan] + [1.0] * (d - 1), 1, 0), (9100, [inf] * d, 1, 0), (9150, [None] + [1.0] * (d - 1), 1, 0), (9200, rows[0][1], None, 0), (None, rows[0][1], 1, 0), (None, None, None, None)]
        rows += [(9250, [0.0] * d, 1, 0), (9300, [], 1, 0), (9301, [], 2, 0), (9302, [], 1, 0), (9350, [1.0, 2.0], 1, 0), (9351, [2.0, 4.0], 1, 0), (9352, [1.0, 3.5], 2, 0), (9353, [1.0, 3.0], 2, 0)]
        rows += [rows[3], rows[50], rows[50], (9400, [1e30] * d, 1, 0), (9401, [3e4] + [0.0] * (d - 1), 1, 0), (9402, [2e4] + [0.0] * (d - 1), 2, 0), (-50, rows[7][1], 3, 0), (50, rows[9][1], 3, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int").repartition(3)


def brute(df, every=50, positives=5, negatives=3):
    rows = []
    for r in df.collect():
        if r.vec_id is None or r.label is None or r.embedding is None or any(v is None or not np.isfinite(v) for v in r.embedding):
            continue
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        rows.append((r.vec_id, label, [max(-hn.LIMIT, min(hn.LIMIT, int(np.floor(256 * float(v))))) for v in r.embedding]))
    out = []
    for a, lab, e in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(e, f, strict=True)), b, m) for b, m, f in rows if b != a and len(f) == len(e))
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            fit = [(n, t) for t, n, m in scored if m != lab and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (n, t) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("node,anchor_node,first", [(None, None, 4), (40, 5, 1), (7, 3, 2)])
def test_against_brute_force(spark, node, anchor_node, first, monkeypatch):
    monkeypatch.setattr(hn, "FIRST", first)
    monkeypatch.setattr(hn, "GROWTH", 3)
    df = frame(spark, clustered(), np.random.default_rng(3).integers(0, 10, 900))
    want = brute(df)
    assert len(want) > 100
    assert sorted(tuple(r) for r in hn.digest(df, node=node, anchor_node=anchor_node).collect()) == want


def test_crowds_and_ties(spark):
    """A vector that a third of the rows hold, one label for half of them, labels of one row each."""
    x = clustered(600, 8, 5)
    x[::3] = x[0]
    labels = np.where(np.arange(600) % 2, 1, np.arange(600) % 11)
    labels[500:] = np.arange(100) + 50
    df = frame(spark, x, labels, odd=False)
    assert sorted(tuple(r) for r in hn.digest(df, node=16, anchor_node=4).collect()) == brute(df)


def test_few_or_none(spark):
    df = frame(spark, clustered(60), [1] * 60, odd=False)
    assert hn.digest(df.limit(0)).count() == 0
    assert sorted(tuple(r) for r in hn.digest(df).collect()) == brute(df)
    assert hn.digest(df.where("vec_id = 50")).count() == 0 and hn.digest(df.where("vec_id = 3")).count() == 0
    assert hn.digest(df.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0


def test_intervals_hold_every_score():
    r = np.random.default_rng(8)
    a, c = (r.integers(-300, 300, (n, 5)) for n in (150, 700))
    (order, cuts), (first, own) = hn.grow(c.astype(float), 16), hn.grow(a.astype(float), 8)
    assert sorted(order.tolist()) == list(range(700))
    one, two = hn._Tree(a[first].astype(float), own), hn._Tree(c[order].astype(float), cuts)
    assert max(np.diff(two.levels[-1])) <= 16 and all((np.diff(level) > 0).all() for level in two.levels)
    for k in range(len(two.levels) - 1):
        nodes, counts = two.below(k, np.arange(len(two.levels[k]) - 1))
        assert nodes.tolist() == list(range(len(two.levels[k + 1]) - 1)) and set(counts.tolist()) <= {1, 2}
    for la, (ca, ra, na) in zip(one.levels, one.stats, strict=True):
        for lc, (cc, rc, nc) in zip(two.levels, two.stats, strict=True):
            for i in range(len(ca)):
                for j in range(0, len(cc), 5):
                    s = one.x[la[i] : la[i + 1]] @ two.x[lc[j] : lc[j + 1]].T
                    spread = ra[i] * nc[j] + rc[j] * na[i] + ra[i] * rc[j] + 1e-6
                    assert abs(s - ca[i] @ cc[j]).max() <= spread


def test_equal_rows_are_cut_in_halves():
    order, cuts = hn.grow(np.ones((100, 3)), 16)
    levels = hn.levels_of(cuts, 100)
    assert np.diff(levels[-1]).max() <= 16 and len(levels) == 4
    assert [len(x) for x in hn.levels_of(hn.grow(np.ones((1, 3)), 16)[1], 1)] == [2]


def test_pruning_skips_whole_groups():
    """Far groups of anchors and candidates: most pairs of leaves are never scored, and the result is that of all."""
    r = np.random.default_rng(9)
    centres = 400 * np.eye(8, dtype=int)
    a, c = (np.concatenate([x + r.integers(-9, 9, (n, 8)) for x in centres]) for n in (64, 512))
    (of_a, a_cuts), (of_c, c_cuts) = hn.grow(a.astype(float), hn.ANCHOR_LEAF), hn.grow(c.astype(float), hn.LEAF)
    a, c = a[of_a], c[of_c]
    ids, labels = np.arange(len(c)), np.zeros(len(c), np.int64)
    windows = np.array([(k, 0, hn.NONE + 1, -hn.NONE - 1, 100_000, 0) for k in range(len(a))])
    cell = hn.Cell(8, (np.full(len(a), -1), np.zeros(len(a), np.int64), a, a_cuts), (ids, labels, c, c_cuts), windows, 3, True)
    left = len(cell.leaf_pairs()[0])
    assert left <= (len(cell.trees[0].levels[-1]) - 1) * (len(cell.trees[1].levels[-1]) - 1) / 4
    at, _, found, score = cell.search()
    for k in range(0, len(a), 37):
        want = sorted(zip((-(c @ a[k])).tolist(), ids.tolist(), strict=True))[:3]
        assert sorted(zip((-score[at == k]).tolist(), found[at == k].tolist(), strict=True)) == want
