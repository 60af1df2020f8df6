"""The mixture as a table gives the steps of the mixture on the driver."""

import numpy as np
import pytest

from softcluster.operators import mixture, mixture_table


@pytest.mark.parametrize("d, k, block_bytes", [(3, 2, 1 << 10), (70, 4, 1 << 16), (130, 2, 64 << 20)])
def test_same_steps(spark, d, k, block_bytes):
    rng = np.random.default_rng(d)
    centres = rng.normal(size=(k, d)) * 2
    x = centres[rng.integers(k, size=1500)] + rng.normal(size=(1500, d))
    pts = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "features array<double>")
    start = mixture.Mixture(np.full(k, 1 / k), centres + 0.3, np.stack([np.eye(d)] * k))
    want = mixture.train(pts, k=k, max_iter=3, tol=0.0, init=start)
    got = mixture_table.train(pts, start.to_df(spark), max_iter=3, tol=0.0, block_bytes=block_bytes)
    assert np.allclose([t["llh"] for t in got.trace], [t["llh"] for t in want.trace], rtol=1e-10)
    back = mixture.Mixture.from_df(got.components())
    for a, b in ((back.weights, want.weights), (back.mus, want.mus), (back.sigmas, want.sigmas)):
        assert np.allclose(a, b, rtol=1e-6, atol=1e-8)


def test_equal_rows_are_spread(spark):
    pts = spark.createDataFrame([([1.0, 2.0],)] * 4000, "features array<double>")
    dealt, blocks, d = mixture_table.deal(pts, block_bytes=4000)
    sizes = [r["count"] for r in dealt.groupBy("block").count().collect()]
    assert d == 2 and blocks == 16 and len(sizes) == 16 and max(sizes) < 2 * 4000 / 16
    dealt.unpersist()


def test_singular_covariance(spark):
    pts = spark.createDataFrame([([float(i % 7), 3.0],) for i in range(200)], "features array<double>")
    start = mixture.Mixture(np.array([0.5, 0.5]), np.array([[1.0, 3.0], [5.0, 3.0]]), np.stack([np.diag([1.0, 0.0])] * 2))
    want = mixture.train(pts, k=2, max_iter=1, tol=0.0, init=start)
    got = mixture.Mixture.from_df(mixture_table.train(pts, start.to_df(spark), max_iter=1, tol=0.0).components())
    assert np.allclose(got.mus, want.mus) and np.allclose(got.sigmas, want.sigmas, atol=1e-9)
