"""Sparse points: the dense kernels' results by non-zeros."""

import numpy as np
import pytest

from softcluster.functions.sparse import PlaceSums, SparseCenters
from softcluster.operators import fuzzy, kmeans, sparse
from softcluster.sources import sparse as P


def made(spark, n=300, d=30, seed=1):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, d)) < 0.2, rng.integers(-3, 4, (n, d)).astype(float), 0.0)
    x[::50] = 0.0  # rows without non-zeros
    x[1::40] = x[1]  # repeated rows
    dense = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    return x, dense, P.from_dense(dense, "features")


def full(centers, d):
    out = np.zeros((centers.k, d))
    out[centers.cluster, centers.index] = centers.value
    return out


def table(spark, c):
    return spark.createDataFrame([(j, i, float(v)) for j, r in enumerate(c) for i, v in enumerate(r) if v], "cluster int, index int, value double")


def test_kmeans_as_dense(spark):
    x, dense, pts = made(spark)
    start = x[[3, 4, 5, 6, 7]]
    model = sparse.train_kmeans(pts, 5, init=table(spark, start), max_iter=4, epsilon=0.0)
    want = kmeans.train(dense.select("features"), k=5, max_iter=4, epsilon=0.0, init=start)
    assert np.allclose(full(model.centers, 30), want.centers, atol=1e-12)
    assert np.allclose([t["value"] for t in model.trace], [t["value"] for t in want.trace])
    got = {r["id"]: (r["cluster"], r["dist2"]) for r in sparse.assign(pts, model.centers).collect()}
    dist = kmeans.sqdist(x, want.centers)
    assert all(got[i][0] == dist[i].argmin() and abs(got[i][1] - dist[i].min()) < 1e-9 for i in range(len(x)))
    assert {r["id"]: r["prediction"] for r in model.predict(pts).collect()} == {i: c for i, (c, _) in got.items()}


def test_fuzzy_as_dense(spark):
    x, dense, pts = made(spark, seed=2)
    start = x[[3, 4, 5]]
    model = sparse.train_fuzzy(pts, 3, m=1.7, init=table(spark, start), max_iter=3, epsilon=0.0)
    want = fuzzy.train(dense.select("features"), k=3, m=1.7, max_iter=3, epsilon=0.0, init=start)
    assert np.allclose(full(model.centers, 30), want.centers, atol=1e-10)
    u = {r["id"]: r["u"] for r in sparse.memberships(pts, model.centers, 1.7).collect()}
    exact = fuzzy.fuzzy_u(kmeans.sqdist(x, want.centers), 1.7)
    assert all(np.allclose(u[i], exact[i]) for i in range(len(x)))
    with pytest.raises(ValueError):
        sparse.memberships(pts, model.centers, 1.0)


def test_memory_follows_nonzeros(spark):
    """A dimension of two billion costs nothing."""
    far = 2_000_000_000
    rows = [(i, [i % 3, far + i % 2], [1.0, 5.0]) for i in range(100)]
    pts = spark.createDataFrame(rows, "id long, indices array<int>, values array<double>")
    assert P.validate(pts).dim == far + 2
    model = sparse.train_kmeans(pts, 2, init=spark.createDataFrame([(0, far, 5.0), (1, far + 1, 5.0)], "cluster int, index int, value double"), epsilon=0.0)
    assert len(model.centers.value) == 8 and model.trace[-1]["max_shift"] == 0.0
    assert {(r["id"] % 2, r["prediction"]) for r in model.predict(pts).collect()} == {(0, 0), (1, 1)}


def test_empty_cluster_keeps_its_centre_and_ties_go_low(spark):
    pts = spark.createDataFrame([(1, [0], [1.0]), (2, [], [])], "id long, indices array<int>, values array<double>")
    init = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (2, 7, 50.0)], "cluster int, index int, value double")
    model = sparse.train_kmeans(pts, 3, init=init, max_iter=1, epsilon=0.0)
    assert full(model.centers, 8).tolist() == [[0.5] + [0.0] * 7, [1.0] + [0.0] * 7, [0.0] * 7 + [50.0]]


def test_entries(spark):
    rows = [(1, 5, 2.0), (1, 2, 1.0), (1, 5, 3.0), (2, 1, 1.0), (2, 1, -1.0), (None, 1, 1.0), (3, None, 1.0), (3, 1, None), (4, 9, 2.0)]
    got = P.from_entries(spark.createDataFrame(rows, "doc long, term int, n double"), "doc", "term", "n")
    assert sorted(map(tuple, got.collect())) == [(1, [2, 5], [1.0, 5.0]), (4, [9], [2.0])]
    assert P.unit_length(got).where("id = 4").first()["values"] == [1.0]


@pytest.mark.parametrize("row", [([2, 1], [1.0, 1.0]), ([1, 1], [1.0, 1.0]), ([-1], [1.0]), ([1], [1.0, 2.0]), ([1], [None]), (None, [1.0])])
def test_faulty_rows_raise(spark, row):
    with pytest.raises(ValueError):
        P.validate(spark.createDataFrame([(1, *row)], "id long, indices array<int>, values array<double>"))


def test_random_start_is_keyed(spark):
    _, _, pts = made(spark)
    first, again = (sorted(map(tuple, sparse.init_random(p, 6, seed=3).collect())) for p in (pts, pts.repartition(7)))
    assert first == again
    with pytest.raises(ValueError):
        sparse.init_random(pts.where("id % 50 = 0"), 2)


def test_sums_merge(monkeypatch):
    monkeypatch.setattr("softcluster.functions.sparse.MERGE_AT", 10)
    sums = PlaceSums()
    rng = np.random.default_rng(1)
    want = {}
    for _ in range(50):
        c, i = rng.integers(0, 4, 7), rng.integers(-2, 5, 7)
        sums.add(c, i, np.ones(7))
        for k in zip(c.tolist(), i.tolist()):
            want[k] = want.get(k, 0) + 1
    got = {(c, i): v for b in sums.batches(5) for c, i, v in zip(*(x.to_pylist() for x in b.columns))}
    assert got == want


def test_no_centre_values():
    c = SparseCenters(2, np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    assert c.sqdist(np.array([0, 1, 1]), np.array([3]), np.array([2.0])).tolist() == [[4.0, 4.0], [0.0, 0.0]]
