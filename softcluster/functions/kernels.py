"""Arrow-batch kernels: numpy per batch inside Spark tasks.

Training loops need, per pass, a handful of sums per cluster.  Each task
reads its Arrow batches, accumulates a small dense (keys x slots) array with
numpy and emits one row ``(key, values)`` per key; one small shuffle by key
then sums the partials.  Only keys x slots numbers per partition ever cross
it, whatever the row count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PARTIAL_SCHEMA = "key int, values array<double>"
# Cap on the rows x k x d difference block held in memory per task.
BLOCK_CELLS = 1 << 21
# Partial sums of all tasks that the driver takes without a combining shuffle.
DRIVER_BYTES = 16 << 20


def batch_matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    """ListArray<double> column of a batch -> (rows, dim) float64 matrix."""
    arr = batch.column(batch.schema.get_field_index(name))
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(-1, dim)


def batch_vector(batch: pa.RecordBatch, name: str) -> np.ndarray:
    arr = batch.column(batch.schema.get_field_index(name))
    return np.asarray(arr.to_numpy(zero_copy_only=False), dtype=np.float64)


def sqdist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances (n, k) by direct differences, in row blocks.

    |x|^2 - 2 x.c + |c|^2 would lose digits for points far from the origin.
    """
    n, d = x.shape
    k = c.shape[0]
    out = np.empty((n, k))
    step = max(1, BLOCK_CELLS // max(1, k * d))
    for s in range(0, n, step):
        diff = x[s:s + step, None, :] - c[None, :, :]
        out[s:s + step] = np.sum(diff * diff, axis=2)
    return out


def fuzzy_u(dist: np.ndarray, m: float) -> np.ndarray:
    """Fuzzy memberships from squared distances (rows sum to 1).

    u_j = (dmin/d_j)^(1/(m-1)) / sum_l (dmin/d_l)^(1/(m-1)); the ratio form
    never under/overflows.  A row on c centres (distance 0) gets 1/c each.
    """
    dmin = dist.min(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (dmin / dist) ** (1.0 / (m - 1.0))
    on = dmin[:, 0] <= 0.0
    if on.any():
        r[on] = (dist[on] <= 0.0).astype(np.float64)
    return r / r.sum(axis=1, keepdims=True)


def sums_by_key(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, d) sums of the (rows, d) matrix by key."""
    out = np.zeros((n, rows.shape[1]))
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    if len(found):
        out[found] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _keyed(acc: np.ndarray) -> pa.RecordBatch:
    """Rows (key, values) of the keys that are not all zero."""
    keys = np.flatnonzero(acc.any(axis=1))
    part = acc[keys]
    ends = np.arange(0, part.size + 1, acc.shape[1], dtype=np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(part.reshape(-1)))],
        names=["key", "values"])


def partial_sums(df: DataFrame, shape: tuple[int, int], batch_fn) -> np.ndarray:
    """Run ``batch_fn(batch) -> ndarray[shape]`` over every Arrow batch, sum
    per partition, then per key over the partitions.

    A task emits one array per key.  While all tasks' arrays together are
    under DRIVER_BYTES they are summed as they come in; beyond, tasks that
    each hold some of the keys combine them first.  Returns the dense (keys,
    slots) total on the driver (the model's size, never the data's).
    """
    def run(batches):
        acc = None
        for b in batches:
            if b.num_rows == 0:
                continue
            part = batch_fn(b)
            acc = part if acc is None else acc + part
        if acc is not None:
            yield _keyed(acc)

    return total_sums(df.mapInArrow(run, PARTIAL_SCHEMA), df.rdd.getNumPartitions(), shape)


def total_sums(parts: DataFrame, tasks: int, shape: tuple[int, int]) -> np.ndarray:
    """The dense (keys, slots) total of rows (key, values) that ``tasks`` tasks give."""
    slots = shape[1]

    def combine(batches):
        acc = {}
        for b in batches:
            values = b.column(1).flatten().to_numpy().reshape(-1, slots)
            for key, row in zip(b.column(0).to_pylist(), values):
                acc[key] = row + acc[key] if key in acc else row
        if acc:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(acc), pa.int32()), pa.array([v.tolist() for v in acc.values()], pa.list_(pa.float64()))],
                names=["key", "values"])

    if tasks * shape[0] * slots * 8 > DRIVER_BYTES:
        parts = parts.repartition("key").mapInArrow(combine, PARTIAL_SCHEMA)
    rows = parts.toArrow()
    if not rows.num_rows:
        return np.zeros(shape)
    rows = rows.combine_chunks()
    return sums_by_key(rows["key"].to_numpy(),
                       rows["values"].combine_chunks().flatten().to_numpy().reshape(-1, slots), shape[0])
