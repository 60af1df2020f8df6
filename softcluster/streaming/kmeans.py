"""Streaming k-means (G1-G7) on Structured Streaming.

Each micro-batch is handled in ``foreachBatch``: one Arrow-kernel pass gives
per-cluster sums and counts (the same kernel as batch k-means), the k-row
model is updated on the driver, and the new state is written as parquet under
``<state>/batch_id=N``.  A batch always starts from the newest state with a
smaller id and overwrites its own folder, so a replayed batch (after a driver
or executor failure) changes nothing.  The state folder and the stream
checkpoint live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import centers as C
from ..functions.draws import normal_value
from ..operators import kmeans
from ..session import scratch_table_dir
from ..sources import points as P
from ..sources.stream import BlockFeed

BATCHES, POINTS = "batches", "points"
DYING = 1e-16  # least total weight that divides
STATE_SCHEMA = T.StructType([
    T.StructField("cluster", T.IntegerType(), False),
    T.StructField("center", T.ArrayType(T.DoubleType(), False), False),
    T.StructField("weight", T.DoubleType(), False),
])


def decay_from_half_life(half_life: float) -> float:
    """a = exp(ln 0.5 / h)."""
    if half_life <= 0:
        raise ValueError("half life must be > 0")
    return math.exp(math.log(0.5) / half_life)


def apply_update(centers: np.ndarray, weights: np.ndarray, sums: np.ndarray,
                 counts: np.ndarray, decay: float, time_unit: str):
    """G2-G4 on k-row state.  Returns new (centers, weights, split flag).

    A centre is the mean of what it has seen, older rows fading: its weight
    fades by the decay (once, or once per row of the batch), then the batch's
    rows join it.  A cluster that got no row keeps its centre.
    """
    if time_unit not in (BATCHES, POINTS):
        raise ValueError(f"invalid time unit {time_unit!r}")
    faded = weights * decay ** (1.0 if time_unit == BATCHES else float(counts.sum()))
    total = faded + counts
    got = counts > 0
    mixed = (faded[:, None] * centers + sums) / np.maximum(total, DYING)[:, None]
    return _revive(np.where(got[:, None], mixed, centers), np.where(got, total, faded))


def _revive(centers: np.ndarray, weights: np.ndarray):
    """When the lightest cluster has all but died, the heaviest one is
    parted: both take half of their weight, a hair to either side of it."""
    lo, hi = int(weights.argmin()), int(weights.argmax())
    if not weights[lo] < 1e-8 * weights[hi]:
        return centers, weights, False
    pair = [hi, lo]
    hair = 1e-14 * np.maximum(np.abs(centers[hi]), 1.0)
    centers[pair] = centers[hi] + np.outer([1.0, -1.0], hair)
    weights[pair] = weights[pair].mean()
    return centers, weights, True


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _opened(stream: DataFrame | BlockFeed):
    """(stream, micro-batch -> its points)."""
    if isinstance(stream, BlockFeed):
        return stream.stream(SparkSession.active()), stream.rows
    return stream, lambda df: df


@dataclass
class StreamingKMeans:
    """Model state = k rows; ``state_dir`` holds one folder per batch id."""

    k: int
    decay: float = 1.0
    time_unit: str = BATCHES
    state_dir: str | None = None
    features: str = P.FEATURES
    keep_states: int | None = 8  # newest states kept (None: keep all)

    def __post_init__(self):
        if self.time_unit not in (BATCHES, POINTS):
            raise ValueError(f"invalid time unit {self.time_unit!r}")
        if not 0.0 <= self.decay <= 1.0:
            raise ValueError("decay factor must be in [0, 1]")

    # G3
    def set_half_life(self, half_life: float, time_unit: str = BATCHES):
        self.decay = decay_from_half_life(half_life)
        self.time_unit = time_unit
        return self

    def _dir(self, spark: SparkSession) -> str:
        if self.state_dir is None:
            self.state_dir = scratch_table_dir(spark, f"stream-kmeans-{uuid.uuid4().hex}")
        return self.state_dir

    # G5
    def set_initial_centers(self, spark: SparkSession, centers: np.ndarray,
                            weights) -> "StreamingKMeans":
        centers = np.asarray(centers, dtype=np.float64)
        if centers.shape[0] != self.k:
            raise ValueError("need k initial centres")
        w = np.broadcast_to(np.asarray(weights, dtype=np.float64), (self.k,))
        self._write(spark, -1, centers, w)
        return self

    def set_random_centers(self, spark: SparkSession, dim: int, weight: float,
                           seed: int = 0) -> "StreamingKMeans":
        """Normal draws keyed by cluster and coordinate."""
        drawn = np.array([[normal_value(seed, j, i) for i in range(dim)] for j in range(self.k)])
        return self.set_initial_centers(spark, drawn, np.full(self.k, weight))

    def _write(self, spark, batch_id, centers, weights):
        rows = [(j, [float(v) for v in centers[j]], float(weights[j]))
                for j in range(self.k)]
        (spark.createDataFrame(rows, STATE_SCHEMA).coalesce(1).write.mode("overwrite")
         .parquet(f"{self._dir(spark)}/batch_id={batch_id}"))

    def _read(self, spark, before: int | None = None):
        """Newest state with id < ``before`` (all ids when None): one top-k
        query over the state folders (each holds exactly k rows)."""
        root = self._dir(spark)
        st = spark.read.parquet(root)
        if before is not None:
            st = st.where(F.col("batch_id") < before)
        rows = st.orderBy(F.col("batch_id").desc(), "cluster").limit(self.k).collect()
        if not rows:
            raise ValueError("no state: set initial or random centres first")
        last = rows[0]["batch_id"]
        if len(rows) != self.k or any(r["batch_id"] != last for r in rows):
            raise ValueError(f"state of batch {last} does not hold k = {self.k} rows")
        rows = sorted(rows, key=lambda r: r["cluster"])
        return (np.array([r["center"] for r in rows], dtype=np.float64),
                np.array([r["weight"] for r in rows], dtype=np.float64), int(last))

    def _prune(self, spark: SparkSession, before: int) -> None:
        """Drop state folders with id < ``before`` (Hadoop FileSystem API, so
        any shared file system works).  A replay of batch N needs only the
        state of N-1, which is kept."""
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self._dir(spark))
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return
        for st in fs.listStatus(root):
            name = st.getPath().getName()
            if name.startswith("batch_id="):
                try:
                    bid = int(name.split("=", 1)[1])
                except ValueError:
                    continue
                if bid < before:
                    fs.delete(st.getPath(), True)

    # G2
    def update(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        centers, weights, _ = self._read(spark, before=batch_id)
        pts = P.clean(batch.select(self.features), self.features)
        sums = kmeans.step_sums(pts, centers, self.features)
        d = centers.shape[1]
        new_c, new_w, _ = apply_update(centers, weights, sums[:, :d], sums[:, d],
                                       self.decay, self.time_unit)
        self._write(spark, batch_id, new_c, new_w)
        if self.keep_states is not None:
            self._prune(spark, batch_id - self.keep_states + 1)

    # G1
    def train_on(self, stream: DataFrame | BlockFeed, checkpoint: str | None = None,
                 available_now: bool = True):
        """Update by every micro-batch of a stream of points or of a feed of blocks."""
        stream, rows = _opened(stream)
        ck = checkpoint or self._dir(stream.sparkSession) + "-checkpoint"
        w = stream.writeStream.foreachBatch(lambda df, bid: self.update(rows(df), bid)).option(
            "checkpointLocation", ck)
        w = w.trigger(availableNow=True) if available_now else w
        return w.start()

    def latest(self, spark: SparkSession) -> DataFrame:
        """The latest centres and weights, readable at any time."""
        c, w, bid = self._read(spark)
        return C.to_df(spark, c, weight=w).withColumn("batch_id", F.lit(bid).cast("long"))

    def latest_centers(self, spark: SparkSession) -> np.ndarray:
        return self._read(spark)[0]

    # G6 / G7
    def predict_on(self, stream: DataFrame | BlockFeed, out_dir: str, keep=(),
                   checkpoint: str | None = None, available_now: bool = True):
        """Score each micro-batch with the newest centres (re-read per batch);
        output folder per batch id, overwritten on replay.

        The centres that a batch meets first are written beside the output
        before it is scored; a replay reads those, whatever states have come
        or gone since."""
        keep = list(keep)
        stream, rows = _opened(stream)
        pins = out_dir.rstrip("/") + "-centers"

        def score(df, bid):
            spark = df.sparkSession
            pin = f"{pins}/batch_id={bid}"
            if not exists(spark, f"{pin}/_SUCCESS"):
                C.to_df(spark, self.latest_centers(spark)).coalesce(1).write.mode("overwrite").parquet(pin)
            cs = C.from_df(spark.read.parquet(pin))
            pts = P.clean(rows(df), self.features)
            out = kmeans.predict(pts.select(*keep, self.features), cs, self.features)
            out.write.mode("overwrite").parquet(f"{out_dir}/batch_id={bid}")

        ck = checkpoint or out_dir.rstrip("/") + "-checkpoint"
        w = stream.writeStream.foreachBatch(score).option("checkpointLocation", ck)
        w = w.trigger(availableNow=True) if available_now else w
        return w.start()
