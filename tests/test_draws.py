"""Keyed draws: the same on any partitioning, with the right distributions."""

import math

import pytest
from pyspark.sql import functions as F

from softcluster.functions import draws
from softcluster.operators import fuzzy, kmeans, topics_online


def test_driver_and_columns_draw_alike(spark):
    rows = spark.range(50).select("id", draws.uniform(7, "id").alias("u"), draws.normal(7, "id", F.lit("x")).alias("z")).collect()
    assert all(r["u"] == draws.uniform_value(7, r["id"]) for r in rows)
    assert all(abs(r["z"] - draws.normal_value(7, r["id"], "x")) < 1e-12 for r in rows)


def test_distributions(spark):
    df = spark.range(20_000).select(draws.uniform(1, "id").alias("u"), draws.normal(2, "id").alias("z"),
                                    draws.poisson(0.7, draws.uniform(3, "id")).alias("n"))
    r = df.agg(F.avg("u"), F.avg("z"), F.var_pop("z"), F.avg("n"), F.var_pop("n"), F.min("u"), F.max("u")).first()
    assert abs(r[0] - 0.5) < 0.01 and abs(r[1]) < 0.03 and abs(r[2] - 1) < 0.04
    assert abs(r[3] - 0.7) < 0.03 and abs(r[4] - 0.7) < 0.05 and 0 < r[5] and r[6] < 1
    assert draws.poisson_steps(0.0) == []
    assert math.isclose(draws.poisson_steps(0.5)[1], 1.5 * math.exp(-0.5))


def points(spark, parts):
    rows = [([float(i % 5), 1.0],) for i in range(300)] + [([float(i), 2.0],) for i in range(300)]
    return spark.createDataFrame(rows, "features array<double>").repartition(parts)


@pytest.mark.parametrize("draw", [lambda p: fuzzy.init_random(p, 12, seed=5), lambda p: kmeans.init_random(p, 6, 2, seed=5)])
def test_any_partitioning_gives_the_same(spark, draw):
    assert draw(points(spark, 1)).tolist() == draw(points(spark, 9)).tolist()


def test_few_distinct_rows(spark):
    """Two distinct rows among many: no more than those reach the driver."""
    df = spark.range(20_000).select(F.array((F.col("id") % 2).cast("double")).alias("features"))
    assert sorted(fuzzy.init_random(df, 2, seed=1).tolist()) == [[0.0], [1.0]]
    with pytest.raises(ValueError):
        fuzzy.init_random(df, 3, seed=1)
    assert len(draws.first_distinct(df, ["features"], 3, 1)) == 2


def test_sample_without_key_counts_copies(spark):
    """A row of three quarters of the table is three quarters of a sample, in expectation."""
    df = spark.range(400).select(F.when(F.col("id") < 300, -1).otherwise(F.col("id")).alias("x"))
    share = [draws.sample_rows(df, ["x"], 40, seed).where("x = -1").count() for seed in range(12)]
    assert 26 < sum(share) / len(share) < 34
    every = draws.sample_rows(df, ["x"], 1000, 1)
    assert every.count() == 400 and every.where("x = -1").count() == 300
    assert sorted(r["place"] for r in every.collect()) == list(range(400))


def test_minibatches_do_not_depend_on_partitions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"))
    for replaced in (True, False):
        one, many = (sorted(r[0] for r in topics_online.minibatch(docs.repartition(n), 0.3, replaced, 4).collect()) for n in (1, 11))
        assert one == many and 780 < len(one) < 1020
        assert (len(set(one)) < len(one)) == replaced
