"""A feed of blocks of any size, one per micro-batch."""

import numpy as np
from pyspark.sql import functions as F

from softcluster.sources.stream import write_feed
from softcluster.streaming.kmeans import StreamingKMeans


def feed_of(spark, sizes, parts=8):
    """Block b holds ``sizes[b]`` rows."""
    ends = np.cumsum(sizes)
    blk = F.coalesce(*[F.when(F.col("id") < int(e), b) for b, e in enumerate(ends)])
    df = spark.range(int(ends[-1])).repartition(parts).select(
        F.array((F.col("id") % 7).cast("double"), (F.col("id") % 3).cast("double")).alias("features"), blk.cast("int").alias("blk"))
    return df, write_feed(df, "blk")


def test_blocks_of_a_hundred_to_one(spark):
    sizes = [100_000, 1_000, 100_000, 3]
    df, feed = feed_of(spark, sizes)
    seen = []

    def batch(entries, number):
        rows = feed.rows(entries)
        per = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        seen.append((number, sum(per), max(per)))

    feed.stream(spark).writeStream.foreachBatch(batch).trigger(availableNow=True).start().awaitTermination()
    assert [(b, n) for b, n, _ in seen] == list(enumerate(sizes))
    assert all(most <= 2 * 100_000 / 4 for _, _, most in seen)  # four cores


def test_same_states_as_blocks_fed_by_hand(spark):
    df, feed = feed_of(spark, [5000, 40, 1, 900])
    start = np.array([[0.0, 0.0], [5.0, 2.0]])
    streamed = StreamingKMeans(k=2, decay=0.5).set_initial_centers(spark, start, 1.0)
    streamed.train_on(feed).awaitTermination()
    fed = StreamingKMeans(k=2, decay=0.5).set_initial_centers(spark, start, 1.0)
    for b in range(4):
        fed.update(df.where(F.col("blk") == b), b)
    one, other = (m.latest(spark).orderBy("cluster").collect() for m in (streamed, fed))
    assert one[0]["batch_id"] == other[0]["batch_id"] == 3
    for a, b in zip(one, other):
        assert np.allclose(a["center"], b["center"]) and np.isclose(a["weight"], b["weight"])


def test_null_block_and_empty_table(spark):
    df = spark.createDataFrame([([1.0], None), ([2.0], 4)], "features array<double>, blk int")
    feed = write_feed(df, "blk")
    got = []
    feed.stream(spark).writeStream.foreachBatch(lambda e, n: got.append([r[0] for r in feed.rows(e).collect()])).trigger(
        availableNow=True).start().awaitTermination()
    assert got == [[[1.0]], [[2.0]]]
