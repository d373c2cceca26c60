"""Dual-tree search against all scores."""

import math

import numpy as np
import pyarrow as pa

from vellumflow.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>, row long, n int, score string"


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    """Sorted result; scores by Python's integers. rows: (vec_id, label, components)."""
    part = []
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        if sum((abs(scale * x) + 1) * (abs(scale * x) + 1) for x in v) <= hn.LONGEST:
            part.append((i, label, [math.floor(scale * x) for x in v]))
    out = []
    for a, (i, label, v) in enumerate(part):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, other) for b, (j, other, w) in enumerate(part) if b != a and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            some = sorted(x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)[:negatives]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(some)]
    return sorted(out)


def mined(spark, rows, **options):
    # The further columns have names that are used inside.
    df = spark.createDataFrame([(*r, 0, 1, "s") for r in rows], SCHEMA).repartition(3)
    got = hn.mine_hard_negatives(df, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r) for r in got.collect())


def test_given_vectors(spark):
    rows = [(r.vec_id, r.label, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = mined(spark, rows, every=20)
    assert got == brute(rows, every=20) and len(got) > 500


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (100, 2, [1.0, 0.25]), (200, 1, [0.0, 0.0]), (300, 1, [-1.0, 0.1]), (None, 1, [1.0, 1.0]), (1, None, [1.0, 1.0])]
    rows += [(2, 1, None), (3, 1, []), (4, 1, [1.0, None]), (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (7, 2, [1e300, 1.0]), (8, 2, [1.0, 1.0, 1.0]), (400, 3, [1.0, 2.0, 3.0]), (9, 3, [1.0, 2.0, 2.0])]
    # Repeated rows, equal scores, and scores beyond what doubles hold exactly.
    rows += [(0, 1, [1.0, 0.5])] * 2 + [(10 + i, 1 + i % 3, [0.5, 0.25]) for i in range(12)] + [(30 + i, 2, [0.25 + i / 100, 0.2]) for i in range(30)]
    rows += [(500 + i, i % 2, [4e5 + i, 3e5 - i, 1.0, 2.0]) for i in range(0, 301)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, positives=2, negatives=3, low=0, high=100, scale=1) == brute(rows, positives=2, negatives=3, low=0, high=100, scale=1)


def test_hot_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 4, rng.standard_normal(8).tolist()) for i in range(600)]
    rows += [(600 + i, i % 2, [0.5] * 8) for i in range(400)]
    assert mined(spark, rows) == brute(rows)


def test_no_vectors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(100, 1, [1.0])]) == []


def planted(vectors, labels, leaf, start=0):
    batch = pa.record_batch(
        [pa.array(np.full(len(vectors), vectors.shape[1], np.int32)), pa.array(labels), pa.array(np.arange(len(vectors)) + start), pa.array(np.arange(len(vectors)) + start), pa.array([v.tobytes() for v in vectors], pa.binary())],
        ["dim", "label", "vec_id", "row", "raw"],
    )
    return [hn.Tree(r) for b in hn._plant(batch, leaf) for r in b.to_pylist()]


def test_bounds_hold_and_prune(monkeypatch):
    """Bounds hold for every pair of nodes; on vectors in eight clusters, larger than leaves, most pairs of leaves are never scored."""
    rng = np.random.default_rng(1)
    middles = rng.integers(-1000, 1000, (8, 32))
    labels = rng.integers(0, 8, 4096)
    vectors = (middles[labels] + rng.integers(-20, 20, (4096, 32))).astype(np.int64)
    (tree,), (anchors,) = planted(vectors, labels, hn.LEAF), planted(vectors[:256], labels[:256], hn.ANCHOR_LEAF)
    low, high = anchors.bounds(tree)
    for a in range(0, len(anchors.nodes), 7):
        for c in range(0, len(tree.nodes), 5):
            exact = anchors.products(tree, *anchors.nodes[a, :2], *tree.nodes[c, :2])
            assert low[a, c] <= exact.min() and exact.max() <= high[a, c]
    asks = hn.Asks(anchors, np.arange(256), np.zeros(256, np.int64), np.full(256, hn.NONE + 1), np.full(256, 2**62), 5, True)
    asks.begin()
    scored = []
    real = hn.Asks.score
    monkeypatch.setattr(hn.Asks, "score", lambda self, *a: scored.append(1) or real(self, *a))
    asks.visit(tree)
    leaves = [(t.nodes[:, 2] < 0).sum() for t in (anchors, tree)]
    assert len(scored) < 0.5 * leaves[0] * leaves[1]
    every = anchors.integers @ tree.integers.T
    every[(anchors.labels[:, None] != tree.labels) | (anchors.rows[:, None] == tree.rows)] = hn.NONE
    assert (np.sort(every, axis=1)[:, ::-1][:, :5] == asks.scores).all()
