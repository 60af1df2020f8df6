"""Fast property tests of the numpy kernels (no Spark)."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from softcluster.functions.kernels import fuzzy_u, sqdist
from softcluster.functions.special import digamma, trigamma

finite = st.floats(-1e3, 1e3, allow_nan=False, allow_infinity=False)


@settings(max_examples=60, deadline=None)
@given(arrays(np.float64, (7, 3), elements=finite), arrays(np.float64, (4, 3), elements=finite))
def test_sqdist_matches_brute_force(x, c):
    brute = np.array([[np.sum((xi - cj) ** 2) for cj in c] for xi in x])
    assert np.allclose(sqdist(x, c), brute, rtol=1e-12, atol=1e-9)


@settings(max_examples=60, deadline=None)
@given(arrays(np.float64, (6, 4), elements=st.floats(0, 1e4, allow_nan=False)),
       st.floats(1.05, 4.0))
def test_fuzzy_memberships_are_a_distribution(d, m):
    u = fuzzy_u(d, m)
    assert np.all(u >= 0) and np.allclose(u.sum(axis=1), 1.0)
    # a nearer centre never gets a smaller membership
    for row_d, row_u in zip(d, u):
        order = np.argsort(row_d, kind="stable")
        assert np.all(np.diff(row_u[order]) <= 1e-12)


@settings(max_examples=60, deadline=None)
@given(st.floats(1e-3, 1e3))
def test_digamma_trigamma_recurrences(x):
    a = np.array([x])
    assert np.allclose(digamma(a + 1) - digamma(a), 1.0 / a, rtol=1e-10, atol=1e-12)
    assert np.allclose(trigamma(a) - trigamma(a + 1), 1.0 / (a * a), rtol=1e-10, atol=1e-12)


def test_row_order_and_partitioning_do_not_matter():
    from softcluster.functions.kernels import _keyed, sums_by_key
    rng = np.random.default_rng(3)
    x = rng.random((50, 2))
    c = np.array([[0.2, 0.2], [0.8, 0.8]])
    full = fuzzy_u(sqdist(x, c), 2.0)
    perm = rng.permutation(50)
    assert np.allclose(fuzzy_u(sqdist(x[perm], c), 2.0), full[perm])
    batch = _keyed(np.array([[0.0, 0.0], [1.0, 2.0]]))
    assert batch.to_pylist() == [{"key": 1, "values": [1.0, 2.0]}]
    keys = rng.integers(0, 5, 50)
    assert np.allclose(sums_by_key(keys, x, 7), [x[keys == j].sum(axis=0) for j in range(7)])


def test_partial_sums_are_the_same_with_and_without_the_shuffle(spark, monkeypatch):
    from softcluster.functions import kernels
    df = spark.range(1000).selectExpr("array(cast(id as double), 1.0D) as x", "id").repartition(6)

    def batch(b):
        x = kernels.batch_matrix(b, "x", 2)
        return kernels.sums_by_key(b.column(1).to_numpy() % 5, x, 7)

    direct = kernels.partial_sums(df, (7, 2), batch)
    monkeypatch.setattr(kernels, "DRIVER_BYTES", 0)
    assert np.array_equal(direct, kernels.partial_sums(df, (7, 2), batch))
    assert direct[:5, 1].tolist() == [200.0] * 5 and not direct[5:].any()
