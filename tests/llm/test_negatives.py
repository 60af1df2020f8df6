"""Hard-negative mining against all scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from softcluster.llm import negatives as N
from softcluster.llm import queries

SCHEMA = "vec_id long, label int, embedding array<float>"


def expected(rows, every, low=80, high=100, k=5):
    """rows: distinct (id, label, q) of integers."""
    out = []
    for a in (r for r in rows if r[0] % every == 0):
        scores = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in rows if r[0] != a[0])
        for p in [r for r in scores if r[2] == a[1]][:k]:
            inside = [r for r in scores if r[2] != a[1] and -low * p[0] <= -100 * r[0] <= -high * p[0]][:k]
            out += [(a[0], p[1], rank, r[1], -p[0], -r[0]) for rank, r in enumerate(inside, 1)]
    return sorted(out)


def mine(spark, rows, every, **kw):
    points = N.integer_rows(spark.createDataFrame(rows, SCHEMA), F.col("label"), F.col("embedding"))
    got = N.hard_negatives(points, F.col("id") % every == 0, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def quantised(rows):
    return [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows]


@pytest.mark.parametrize("kw", [{}, {"tile_rows": 100, "block_rows": 7}])
def test_clusters(spark, kw):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(4)), (centres[rng.integers(6)] + rng.normal(size=8) * 0.3).astype(np.float32).tolist()) for i in range(700)]
    want = expected(quantised(rows), 20)
    assert mine(spark, rows, 20, **kw) == want and len(want) > 100


def test_ties_and_copies(spark):
    rng = np.random.default_rng(2)
    same = [1.0, 0.0, 0.5]
    rows = [(i, i % 3, same) for i in range(0, 300)]
    rows += [(i, int(rng.integers(3)), rng.integers(-1, 2, 3).astype(float).tolist()) for i in range(300, 500)]
    assert mine(spark, rows, 50, tile_rows=64) == expected(quantised(rows), 50)


def test_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.0]), (10, 1, [1.0, 0.1]), (11, 2, [0.9, 0.2]), (12, 2, [1.0]), (13, 2, []), (14, 3, [-1.0, 0.0]), (20, 9, [0.5, 0.5])]
    out = [(None, 1, [1.0, 0.0]), (15, None, [1.0, 0.0]), (16, 1, None), (17, 1, [1.0, None]), (18, 2, [float("nan"), 0.0]),
           (19, 2, [float("inf"), 0.0])]
    padded = [(i, l, v + [0.0] * (2 - len(v))) for i, l, v in rows]
    want = expected(quantised(padded), 10)
    assert mine(spark, rows + out + rows[:3], 10) == want and want
    assert mine(spark, out, 10) == [] and mine(spark, [], 10) == []
    assert mine(spark, rows[2:4], 10) == []
    assert mine(spark, [(0, 1, []), (1, 1, []), (2, 2, [])], 10) == [(0, 1, 1, 2, 0, 0)]


def test_repeated_ids_and_large_components(spark):
    rows = [(0, 1, [3e38, 1.0]), (0, 2, [1.0, 3e38]), (1, 1, [2e38, 0.5]), (2, 2, [0.0, 1e20]), (3, 2, [1e6, 1e6]), (4, 1, [1.0, 1.0])]
    clamped = [(i, l, [max(min(math.floor(256 * x), N.LARGEST), -N.LARGEST) for x in v]) for i, l, v in
               [(i, l, np.float32(v).astype(float).tolist()) for i, l, v in rows]]
    assert mine(spark, rows, 100) == expected(clamped, 100)


def test_boxes_are_pruned():
    """Clustered rows: most are never scored, and the best are found all the same."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 400
    q = (centres[rng.integers(40, size=20_000)] + rng.normal(size=(20_000, 16)) * 20).astype(np.int32)
    labels, ids = rng.integers(0, 5, 20_000), rng.permutation(20_000)
    order = N.str_order(ids, labels, q, np.arange(16))
    assert sorted(order.tolist()) == list(range(20_000))
    tree = N.Tree(ids[order], labels[order], q[order], True)
    for a in range(5):
        scores = q.astype(np.int64) @ q[a].astype(np.int64)
        found = [[]]
        scored = tree.search(q[a], int(ids[a]), int(labels[a]), True, [(-(1 << 62), 1 << 62)], found, 5)
        best = sorted((-s, i) for s, i, l in zip(scores.tolist(), ids.tolist(), labels.tolist()) if l == labels[a] and i != ids[a])[:5]
        assert found[0] == best and scored < 4_000
        top = -best[0][0]
        windows, found = [(top * 8 // 10, top), (top // 2, top * 6 // 10)], [[], []]
        assert tree.search(q[a], int(ids[a]), int(labels[a]), False, windows, found, 5) < 20_000
        assert tree.search(q[a], int(ids[a]), int(labels[a]), False, windows[:1], [[]], 5) < 10_000
        for (lo, hi), got in zip(windows, found):
            assert got == sorted((-s, i) for s, i, l in zip(scores.tolist(), ids.tolist(), labels.tolist()) if l != labels[a] and lo <= s <= hi)[:5]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(0, 1, [1.0], 5, 6, 7, 8), (1, 1, [1.0], 5, 6, 7, 8), (2, 2, [1.0], 5, 6, 7, 8)],
                               "vec_id int, label int, embedding array<double>, id int, at int, q int, slab int")
    points = N.integer_rows(df, F.col("label"), F.col("embedding"))
    assert [tuple(r) for r in N.hard_negatives(points, F.col("id") == 0).collect()] == [(0, 1, 1, 2, 65536, 65536)]


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [math.floor(256 * x) for x in r["embedding"]]) for r in rows]
    assert sorted(map(tuple, queries.QUERIES["op11_hard_negatives"](spark, sf_dir).collect())) == expected(rows, 100)
