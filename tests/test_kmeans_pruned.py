"""Pruned Lloyd passes: the full kernel's results with fewer distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from softcluster.operators import kmeans, kmeans_pruned
from softcluster.plans import fixtures as X


def blobs(spark, n, k, d, seed, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, d)) * 3
    x = centres[rng.integers(k, size=n)] + rng.normal(size=(n, d)) * spread
    return spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>"), x[:k].copy()


@pytest.mark.parametrize("cut", [8, 2])
def test_same_as_full_kernel_with_under_half_the_distances(spark, monkeypatch, cut):
    monkeypatch.setattr(kmeans_pruned, "CUT", cut)
    pts, start = blobs(spark, 6000, 64, 64, 1)
    full = kmeans.train(pts, k=64, max_iter=6, epsilon=0.0, init=start)
    got = kmeans_pruned.train(pts, start, max_iter=6, epsilon=0.0)
    assert np.allclose(got.centers, full.centers, rtol=0, atol=1e-10)
    assert len(got.trace) == len(full.trace)
    assert np.allclose([t["value"] for t in got.trace], [t["value"] for t in full.trace], rtol=1e-12)
    assert all(t["full"] == 6000 * 64 for t in got.trace)
    assert all(t["distances"] < 0.5 * t["full"] for t in got.trace[1:])
    assert sum(t["distances"] for t in got.trace) < 0.5 * sum(t["full"] for t in got.trace)


def test_ties_and_copies_take_the_lowest_index():
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (500, 3)).astype(float)
    centers = np.vstack([x[:6], x[:4], [[0.5, 0, 0]], [[-0.5, 0, 0]]])
    lower = kmeans_pruned.norm_bounds(x, centers)
    cluster, dist, computed = kmeans_pruned.bounded_nearest(
        x, centers, kmeans_pruned.half_distances(centers), np.argmin(lower, axis=1), lower)
    every = kmeans.sqdist(x, centers)
    assert np.array_equal(cluster, every.argmin(axis=1)) and np.array_equal(dist, every.min(axis=1))
    assert (lower <= np.sqrt(every)).all() and computed < every.size


def test_bounds_hold_over_passes():
    rng = np.random.default_rng(3)
    x, centers = rng.normal(size=(400, 5)) + 1e6, rng.normal(size=(20, 5)) + 1e6
    lower = kmeans_pruned.norm_bounds(x, centers)
    cluster = np.argmin(lower, axis=1)
    for _ in range(10):
        cluster, dist, _ = kmeans_pruned.bounded_nearest(x, centers, kmeans_pruned.half_distances(centers), cluster, lower)
        every = kmeans.sqdist(x, centers)
        assert np.array_equal(cluster, every.argmin(axis=1)) and np.array_equal(dist, every.min(axis=1))
        new = centers + rng.normal(size=centers.shape) * 0.1
        lower = np.maximum(lower - np.linalg.norm(new - centers, axis=1) * (1 + kmeans_pruned.SLACK), 0)
        centers = new


def test_one_centre_one_row_and_empty_clusters(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "features array<double>")
    model = kmeans_pruned.train(df, np.array([[5.0, 5.0]]), epsilon=0.0)
    assert model.centers.tolist() == [[1.0, 2.0]] and model.trace[-1]["value"] == 0.0
    model = kmeans_pruned.train(df, np.array([[5.0, 5.0], [50.0, 50.0]]), epsilon=0.0)
    assert model.centers.tolist() == [[1.0, 2.0], [50.0, 50.0]]


def test_assign_matches(spark, sf_dir):
    pts = X.points_li(spark, sf_dir)
    start = kmeans.init_random(pts, 16, seed=4)[0]
    key = ["l_orderkey", "l_linenumber", "cluster", "dist2"]
    full, got = (m.assign(pts, start).select(*key) for m in (kmeans, kmeans_pruned))
    assert got.exceptAll(full).count() == 0 and full.exceptAll(got).count() == 0
    assert got.agg(F.count(F.lit(1))).first()[0] == pts.count()
