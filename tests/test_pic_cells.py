"""Hot vertices of power iteration spread over cells."""

import numpy as np
from pyspark.sql import functions as F

from softcluster.operators import pic


def rows_per_task(dealt):
    per = dealt.edges.groupBy(F.spark_partition_id().alias("p")).count().collect()
    return sorted(r["count"] for r in per)


def test_star_of_a_million_edges_is_even(spark):
    star = spark.range(1_000_000).select((F.col("id") + 1).alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(1.0).alias("weight"))
    w = pic.normalize(star)
    dealt = pic.deal_edges(w)
    sizes = rows_per_task(dealt)
    assert sum(sizes) == 2_000_000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert dealt.hot.count() == 1
    plain = sorted(r["count"] for r in w.repartition(8, "dst").groupBy(F.spark_partition_id()).count().collect())
    assert plain[-1] > 1_000_000  # as dealt by destination alone
    v = spark.range(1_000_001).select("id", F.lit(1.0).alias("v"))
    got = {r["id"]: r["v"] for r in dealt.power_step(v).where("id in (0, 1, 77)").collect()}
    assert all(abs(x - 1.0) < 1e-9 for x in got.values()) and len(got) == 3


def test_steps_equal_the_plain_join(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), float(x)) for a, b, x in zip(rng.integers(0, 30, 4000), rng.integers(0, 6, 4000), rng.random(4000))]
    w = pic.normalize(spark.createDataFrame(rows, "src long, dst long, weight double"))
    v = pic.init_random(w, seed=2)
    plain = {r["id"]: r["v"] for r in pic.power_step(w, v).collect()}
    for least in (1, 10, 100_000):
        got = {r["id"]: r["v"] for r in pic.deal_edges(w, least).power_step(v).collect()}
        assert got.keys() == plain.keys() and all(abs(got[i] - plain[i]) < 1e-12 for i in plain)
    whole = [pic.power_iteration(w, v, max_iter=4, fixed_steps=True, least_cell=c).v.orderBy("id").collect() for c in (1, 100_000)]
    assert np.allclose(*[[r["v"] for r in x] for x in whole])
