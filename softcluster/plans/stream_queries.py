"""Registered streaming k-means queries (section G) and their oracles.

The feed is ``events`` cut into 10-day blocks (3 blocks for the 30 days of
the fixture), one micro-batch per block, oldest first.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import centers as C
from ..functions import draws
from ..session import scratch_table_dir
from ..sources import points as P
from ..sources.stream import write_feed
from ..streaming.kmeans import StreamingKMeans
from . import fixtures as X
from . import sqlgen as S
from .registry import query

K, D, BLOCKS = 4, 2, 3


def ev_feed(spark, sf_dir):
    """events -> (event_id, user_id, features, blk) with blk = 10-day block."""
    ev = X.table(spark, sf_dir, "events").where(F.col("value").isNotNull() & F.col("ts").isNotNull())
    first = ev.agg(F.min(F.to_date("ts"))).first()[0]
    blk = F.floor(F.datediff(F.to_date("ts"), F.lit(first)) / 10).cast("int")
    return ev.select("event_id", "user_id", F.array(
        F.col("value") / 100.0, F.hour("ts") / 24.0).alias(P.FEATURES), blk.alias("blk"))


def start_centers(spark, sf_dir):
    feed = ev_feed(spark, sf_dir)
    return feed, C.from_df(C.group_means(feed, F.floor(F.col(P.FEATURES)[1] * 4.0), dim=D))


def run_static(model: StreamingKMeans, feed):
    """Feed the blocks in order through ``update`` (the foreachBatch body);
    dealt to a folder per block first, so a block reads its own rows only."""
    spark = feed.sparkSession
    root = scratch_table_dir(spark, f"blocks-{uuid.uuid4().hex}")
    feed.select(P.FEATURES, "blk").write.partitionBy("blk").parquet(root)
    dealt = spark.read.parquet(root)
    for i, b in enumerate(sorted(r[0] for r in dealt.select("blk").distinct().collect())):
        model.update(dealt.where(F.col("blk") == b), i)
    return model


def _state_out(model, spark):
    st = model.latest(spark)
    return st.select("cluster", F.round("weight", 4).alias("weight"),
                     F.posexplode("center").alias("dim", "value")).select(
        "cluster", "weight", F.col("dim").cast("int").alias("dim"),
        F.round("value", 6).alias("value"))


def _sql(decay, unit, weights=None, far=False):
    start = S.group_mean_centers("c0", "p", "floor(x1 * 4.0)", K, D)
    ctes = [S.ev_blocks("p"), start]
    src = "c0"
    if far:
        cols = ", ".join((f"{S.ccol(j, i)} + 1000.0" if j == K - 1 else S.ccol(j, i))
                         + f" AS {S.ccol(j, i)}" for j in range(K) for i in range(D))
        ctes.append(S.cte("cf", f"SELECT {cols} FROM c0"))
        src = "cf"
    ctes.append(S.stream_state("s0", src, K, D, weights or ["1.0"] * K))
    for b in range(BLOCKS):
        ctes += S.stream_update(f"s{b + 1}", "p", f"s{b}", b, K, D, decay, unit)
    return ctes, f"s{BLOCKS}"


def _state_sql(decay, unit, weights=None, far=False):
    ctes, last = _sql(decay, unit, weights, far)
    return S.with_(ctes, S.state_long(last, K, D))


@query("stream_kmeans_train", lambda: _state_sql(0.5, "batches"))
def stream_kmeans_train(spark, sf_dir):
    """G1: Structured Streaming, one block per trigger, foreachBatch update."""
    feed, start = start_centers(spark, sf_dir)
    blocks = write_feed(feed.select(P.FEATURES, "blk"), "blk", "events-feed")
    model = StreamingKMeans(k=K, decay=0.5).set_initial_centers(spark, start, 1.0)
    q = model.train_on(blocks)
    q.awaitTermination()
    return _state_out(model, spark)


@query("stream_kmeans_update", lambda: _state_sql(1.0, "batches"))
def stream_kmeans_update(spark, sf_dir):
    """Batch update rule, no forgetting."""
    feed, start = start_centers(spark, sf_dir)
    model = StreamingKMeans(k=K, decay=1.0).set_initial_centers(spark, start, 1.0)
    return _state_out(run_static(model, feed), spark)


@query("stream_kmeans_decay_points", lambda: _state_sql(0.9999, "points"))
def stream_kmeans_decay_points(spark, sf_dir):
    """Decay per point, a^rows per batch."""
    feed, start = start_centers(spark, sf_dir)
    model = StreamingKMeans(k=K, decay=0.9999, time_unit="points").set_initial_centers(
        spark, start, 1.0)
    return _state_out(run_static(model, feed), spark)


HALF_LIFE = 1.5


@query("stream_kmeans_half_life",
       lambda: _state_sql(float(np.exp(np.log(0.5) / HALF_LIFE)), "batches"))
def stream_kmeans_half_life(spark, sf_dir):
    """Decay given as a half-life in batches."""
    feed, start = start_centers(spark, sf_dir)
    model = StreamingKMeans(k=K).set_half_life(HALF_LIFE)
    model.set_initial_centers(spark, start, 1.0)
    return _state_out(run_static(model, feed), spark)


@query("stream_kmeans_split", lambda: _state_sql(
    0.5, "batches", weights=["100.0", "100.0", "100.0", "0.0"], far=True))
def stream_kmeans_split(spark, sf_dir):
    """Centre 3 sits far from all rows with weight 0: it dies at once and
    the heaviest cluster is split in two."""
    feed, start = start_centers(spark, sf_dir)
    start = start.copy()
    start[K - 1] += 1000.0
    model = StreamingKMeans(k=K, decay=0.5).set_initial_centers(
        spark, start, np.array([100.0, 100.0, 100.0, 0.0]))
    return _state_out(run_static(model, feed), spark)


def _random_centers_sql():
    start = S.cte("c0", "SELECT " + ", ".join(f"{draws.normal_sql(13, str(j), str(i))} AS {S.ccol(j, i)}" for j in range(K) for i in range(D)))
    ctes = [S.ev_blocks("p"), start, S.stream_state("s0", "c0", K, D, ["0.0"] * K)]
    for b in range(BLOCKS):
        ctes += S.stream_update(f"s{b + 1}", "p", f"s{b}", b, K, D, 1.0, "batches")
    return S.with_(ctes, S.state_long(f"s{BLOCKS}", K, D))


@query("stream_kmeans_random_centers", _random_centers_sql)
def stream_kmeans_random_centers(spark, sf_dir):
    """N(0, 1) start centres, then the event blocks."""
    feed, _ = start_centers(spark, sf_dir)
    model = StreamingKMeans(k=K, decay=1.0).set_random_centers(spark, D, 0.0, seed=13)
    return _state_out(run_static(model, feed), spark)


def _predict_sql(keep):
    ctes, last = _sql(1.0, "batches")
    ctes += S.assign_ctes("fa", "p", last, K, D, keep=["event_id", "user_id"])
    cols = {"plain": "CAST(round(x0, 6) AS DOUBLE) AS x0, CAST(round(x1, 6) AS DOUBLE) AS x1",
            "keyed": "event_id, user_id"}[keep]
    return S.with_(ctes, f"SELECT {cols}, a AS prediction FROM fa")


def _predict(spark, sf_dir, keep):
    feed, start = start_centers(spark, sf_dir)
    model = StreamingKMeans(k=K, decay=1.0).set_initial_centers(spark, start, 1.0)
    run_static(model, feed)
    blocks = write_feed(feed.select("event_id", "user_id", P.FEATURES, "blk"), "blk", "events-feed")
    out_dir = model.state_dir + "-predictions"
    q = model.predict_on(blocks, out_dir, keep=keep)
    q.awaitTermination()
    return spark.read.parquet(out_dir)


@query("stream_kmeans_predict", lambda: _predict_sql("plain"))
def stream_kmeans_predict(spark, sf_dir):
    """Predictions on a stream with the newest centres, re-read per batch."""
    out = _predict(spark, sf_dir, keep=[])
    return out.select(F.round(F.col(P.FEATURES)[0], 6).alias("x0"),
                      F.round(F.col(P.FEATURES)[1], 6).alias("x1"), "prediction")


@query("stream_kmeans_predict_keyed", lambda: _predict_sql("keyed"))
def stream_kmeans_predict_keyed(spark, sf_dir):
    """Keyed values; the key columns pass through."""
    out = _predict(spark, sf_dir, keep=["event_id", "user_id"])
    return out.select("event_id", "user_id", "prediction")
