"""Candidates reduced in compact groups, and k-means++ with a running minimum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from softcluster.operators import kmeans


def cost(x, w, cs):
    return float(w @ kmeans.sqdist(x, cs).min(axis=1))


def candidates(n, d, clusters, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d)) * 6
    return np.unique(centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, d)), axis=0), rng


@pytest.mark.parametrize("k, clusters", [(256, 40), (256, 256), (64, 400)])
def test_groups_cost_as_much_as_one(spark, k, clusters):
    """The ratio to one group's result stays near 1."""
    x, rng = candidates(10 * k, 6, clusters, k + clusters)
    w = rng.integers(1, 50, len(x)).astype(float)
    one = kmeans._reduce_runs(spark, [x], [w], k, 30, 1)[0]
    many = kmeans._reduce_runs(spark, [x], [w], k, 30, 1, one_group=len(x) // 16)[0]
    ratio = cost(x, w, many) / cost(x, w, one)
    print("cost ratio", k, clusters, round(ratio, 3))
    assert many.shape == (k, 6) and ratio < 1.25


def test_no_group_over_a_thirtysecond_at_k_4096(spark):
    x, rng = candidates(40_960, 4, 1000, 3)
    x[:9000] = x[0] + rng.normal(size=(9000, 4)) * 1e-3  # a dense place
    groups = kmeans._compact_groups(x, kmeans.GROUP_ROWS)
    assert sorted(np.concatenate(groups).tolist()) == list(range(len(x)))
    assert max(map(len, groups)) <= len(x) / 32
    share = kmeans._shares(x, np.ones(len(x)), groups, 4096)
    assert sum(share) == 4096 and min(share) >= 1 and all(s <= len(g) for s, g in zip(share, groups))
    cs = kmeans._reduce_runs(spark, [x], [np.ones(len(x))], 4096, 2, 1, polish=1)[0]
    assert cs.shape == (4096, 4) and len(np.unique(cs, axis=0)) == 4096


def test_equal_candidates_are_not_repeated(spark):
    x = np.repeat(np.arange(12.0)[:, None], 1, axis=1)
    cs = kmeans._reduce_runs(spark, [x, x[:3]], [np.ones(12), np.ones(3)], 8, 5, 1, one_group=4)
    assert len(np.unique(cs[0])) == len(cs[0]) == 8 and sorted(cs[1].ravel().tolist()) == [0.0, 1.0, 2.0]


def test_running_minimum_draws_as_all_centres_would(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    table = spark.createDataFrame([(r.tolist(), float(i % 4)) for i, r in enumerate(x)], "features array<double>, weight double")
    w = np.arange(400) % 4.0
    uniform = kmeans._uniform("features", 9)
    u = np.array([list(r) for r in table.select(*[uniform(s).alias(str(s)) for s in range(20)]).collect()])
    want, least = [], np.ones(400)
    for step in range(20):
        with np.errstate(divide="ignore"):
            race = np.where((w > 0) & (least > 0), -np.log(u[:, step]) / (w * least), np.inf)
        want.append(x[np.argmin(race)])
        least = kmeans.sqdist(x, np.array(want)).min(axis=1)
    for cut in (16, 3):
        monkeypatch.setattr(kmeans, "CUT", cut)
        assert np.array_equal(kmeans.kmeans_pp(table, 20, seed=9), np.array(want))
    same = table.limit(2).withColumn("weight", F.lit(1.0))
    assert len(kmeans.kmeans_pp(same, 5, seed=1)) == 2
