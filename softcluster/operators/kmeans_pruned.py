"""Lloyd passes that leave out distances which cannot matter.

Between passes every row keeps its cluster and a lower bound of its distance
to each centre, as columns.  A pass lowers the bounds by how far the centres
moved, measures the row's own centre, and measures another centre only if its
bound and half its distance from the own centre are within that.  On the first
pass the bounds are the differences of the norms.  Distances are computed as
in the full kernel and bounds carry some slack, so labels (the lowest index on
ties), costs and centres are those of ``kmeans.lloyd``.

A pass is one map: it emits the rows with their new columns, kept in
memory for the next pass, and one row of sums per cluster.  Every ``CUT``
passes the rows are written instead, so that a lost executor costs a few
passes at most.
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.kernels import BLOCK_CELLS, _keyed, batch_matrix, sqdist, sums_by_key, total_sums
from ..functions.scoring import lists, scored
from ..session import cut_lineage
from ..sources import points as P
from .kmeans import KMeansModel, update

CUT = 8
#: Relative slack of bounds against rounding.
SLACK = 1e-9


def half_distances(centers: np.ndarray) -> np.ndarray:
    """(k, k): half of the distance between two centres."""
    return 0.5 * np.sqrt(sqdist(centers, centers)) * (1 - SLACK)


def norm_bounds(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """(n, k) lower bounds: a distance is no less than the difference of both norms."""
    a, b = np.linalg.norm(x, axis=1)[:, None], np.linalg.norm(centers, axis=1)
    return np.maximum(np.abs(a - b) - SLACK * (a + b), 0.0)


def bounded_nearest(x: np.ndarray, centers: np.ndarray, half: np.ndarray, cluster: np.ndarray, lower: np.ndarray
                    ) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centre, squared distance, distances computed) of each row.

    ``lower`` is brought up to date in place.
    """
    rows = np.arange(len(x))
    diff = x - centers[cluster]
    own = np.sum(diff * diff, axis=1)
    reach = (np.sqrt(own) * (1 + SLACK))[:, None]
    near = (lower <= reach) & (half[cluster] <= reach)
    near[rows, cluster] = False
    r, j = np.nonzero(near)
    other = np.empty(len(r))
    step = max(1, BLOCK_CELLS // max(1, x.shape[1]))
    for s in range(0, len(r), step):
        diff = x[r[s:s + step]] - centers[j[s:s + step]]
        other[s:s + step] = np.sum(diff * diff, axis=1)
    dist = np.full(lower.shape, np.inf)
    dist[r, j] = other
    dist[rows, cluster] = own
    lower[r, j] = np.sqrt(other) * (1 - SLACK)
    lower[rows, cluster] = np.sqrt(own) * (1 - SLACK)
    best = np.argmin(dist, axis=1)  # first minimum: lowest index on ties
    return best, dist[rows, best], len(x) + len(r)


def _pass(rows: DataFrame, features: str, centers: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """features, cluster, lower of every row (key null), and key, values of the sums.

    ``moved``: how far each centre went since the rows' bounds were made; none on the first pass.
    """
    k, d = centers.shape
    shared = rows.sparkSession.sparkContext.broadcast((centers, half_distances(centers), moved))
    block = max(1, BLOCK_CELLS // max(1, k))

    def run(batches):
        centers, half, moved = shared.value
        acc = np.zeros((k + 1, d + 2))
        for b in batches:
            every = batch_matrix(b, features, d)
            for s in range(0, len(every), block):
                x = every[s:s + block]
                if moved is None:
                    lower = norm_bounds(x, centers)
                    cluster = np.argmin(lower, axis=1)
                else:
                    part = b.slice(s, len(x))
                    lower = np.maximum(batch_matrix(part, "lower", k) - moved * (1 + SLACK), 0.0)
                    cluster = part.column(1).to_numpy()
                cluster, cost, computed = bounded_nearest(x, centers, half, cluster, lower)
                acc[:k, :d] += sums_by_key(cluster, x, k)
                acc[:k, d] += np.bincount(cluster, minlength=k)
                acc[:k, d + 1] += np.bincount(cluster, weights=cost, minlength=k)
                acc[k, 0] += computed
                acc[k, 1] += len(x)
                # Rounded down, so that they stay bounds.
                small = (lower * (1 - 1e-6)).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [lists(x), pa.array(cluster.astype(np.int32)), lists(small),
                     pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.list_(pa.float64()))], names=names)
        sums = _keyed(acc)
        n = sums.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.float32())),
             sums.column(0), sums.column(1)], names=names)

    names = [features, "cluster", "lower", "key", "values"]
    taken = rows.select(features) if moved is None else rows.where("key is null").select(features, "cluster", "lower")
    return taken.mapInArrow(run, f"{features} array<double>, cluster int, lower array<float>, key int, values array<double>")


def lloyd(data: DataFrame, start: np.ndarray, max_iter: int, epsilon: float, features: str = P.FEATURES) -> KMeansModel:
    """As ``kmeans.lloyd`` for one run.  The trace also holds ``distances``, the
    number computed in a pass, and ``full``, that of a pass without bounds."""
    centers = np.array(start, dtype=np.float64)
    k, d = centers.shape
    tasks = data.rdd.getNumPartitions()
    state, moved, cost, trace, held = data, None, float("inf"), [], None
    try:
        for it in range(1, max_iter + 1):
            t0 = time.time()
            after = _pass(state, features, centers, moved)
            if it % CUT:
                after = after.persist(StorageLevel.MEMORY_AND_DISK)
            else:
                after = cut_lineage(after)
            sums = total_sums(after.where("key is not null").select("key", "values"), tasks, (k + 1, d + 2))
            if held is not None:
                held.unpersist()
            held = after if it % CUT else None
            state = after
            new, went_on, cost, _ = update(centers, sums[:k], epsilon)
            moved = np.sqrt(np.sum((new - centers) ** 2, axis=1))
            centers = new
            trace.append(dict(iteration=it, value=cost, max_shift=float(moved.max()), seconds=time.time() - t0,
                              distances=int(sums[k, 0]), full=int(sums[k, 1]) * k))
            if not went_on:
                break
    finally:
        if held is not None:
            held.unpersist()
    return KMeansModel(centers=centers, cost=cost, trace=trace)


def train(points: DataFrame, init: np.ndarray, max_iter: int = 20, epsilon: float = 1e-4, features: str = P.FEATURES) -> KMeansModel:
    """One run of Lloyd's algorithm from given centres, with pruned passes."""
    data, _ = P.prepare(points.select(features), features)
    try:
        return lloyd(data, init, max_iter, epsilon, features)
    finally:
        data.unpersist()


def assign(points: DataFrame, centers: np.ndarray, features: str = P.FEATURES, keep=None) -> DataFrame:
    """C8 by the norm bound: keep.., features, cluster, dist2."""
    keep = list(keep) if keep is not None else [c for c in points.columns if c != features]
    half = half_distances(np.asarray(centers, dtype=np.float64))

    def fn(x, c, _):
        lower = norm_bounds(x, c)
        cluster, dist, _ = bounded_nearest(x, c, half, np.argmin(lower, axis=1), lower)
        return {"cluster": pa.array(cluster.astype(np.int32)), "dist2": pa.array(dist)}

    return scored(points, features, centers, [*keep, features], {"cluster": T.IntegerType(), "dist2": T.DoubleType()}, fn)
