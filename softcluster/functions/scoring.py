"""Scoring of rows against k centres, for any k and d.

One path for all sizes: numpy on Arrow batches inside Spark tasks, the same
kernels that training uses, so a stored pass and a later scoring of its rows
agree to the last bit.  Centres are model state and travel as a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .kernels import batch_matrix, fuzzy_u, sqdist

DOUBLES = T.ArrayType(T.DoubleType(), False)


def lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    n, k = values.shape
    return pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32),
                                    pa.array(np.ascontiguousarray(values).reshape(-1)))


def scored(df: DataFrame, features: str, state: np.ndarray, keep: list[str] | tuple,
           out: dict[str, T.DataType], fn: Callable) -> DataFrame:
    """keep.. + the columns of ``out``; fn(x, state, batch) gives them for the
    (rows, d) matrix of an Arrow batch."""
    keep = list(dict.fromkeys(keep))
    rows = df.select(*keep, *([] if features in keep else [features]))
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(n, t, False) for n, t in out.items()])
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(state, dtype=np.float64))
    d = shared.value.shape[-1]

    def run(batches):
        for b in batches:
            if b.num_rows:
                got = fn(batch_matrix(b, features, d), shared.value, b)
                yield pa.RecordBatch.from_arrays(
                    [b.column(i) for i in range(len(keep))] + [got[n] for n in out], names=schema.names)

    return rows.mapInArrow(run, schema)


def nearest(df: DataFrame, features: str, centers: np.ndarray, keep: list[str] | tuple) -> DataFrame:
    """keep.. + cluster (lowest index on ties) and dist2."""
    def fn(x, c, _):
        dist = sqdist(x, c)
        best = np.argmin(dist, axis=1)
        return {"cluster": pa.array(best.astype(np.int32)), "dist2": pa.array(dist[np.arange(len(x)), best])}

    return scored(df, features, centers, keep, {"cluster": T.IntegerType(), "dist2": T.DoubleType()}, fn)


def least_distances(df: DataFrame, features: str, centers: list[np.ndarray], keep: list[str] | tuple,
                    prev: str | None, out: str) -> DataFrame:
    """keep.. + out: for each table of centres (none: infinite) the least
    squared distance, no more than that of the array column ``prev``."""
    sizes = [len(c) for c in centers]
    some = np.concatenate([c for c in centers if len(c)])
    last = np.cumsum(sizes)

    def fn(x, c, b):
        dist = sqdist(x, c)
        least = np.column_stack([dist[:, e - n:e].min(axis=1) if n else np.full(len(x), np.inf)
                                 for e, n in zip(last, sizes)])
        if prev is not None:
            least = np.minimum(least, batch_matrix(b, prev, len(sizes)))
        return {out: lists(least)}

    extra = [prev] if prev is not None and prev not in keep else []
    got = scored(df, features, some, [*keep, *extra], {"_least": DOUBLES},
                 lambda x, c, b: {"_least": fn(x, c, b)[out]})
    return got.drop(*extra).drop(out).withColumnRenamed("_least", out)


def memberships(df: DataFrame, features: str, centers: np.ndarray, m: float,
                keep: list[str] | tuple, out: str = "u") -> DataFrame:
    """keep.. + out ARRAY<DOUBLE>: fuzzy memberships (sum to 1)."""
    return scored(df, features, centers, keep, {out: DOUBLES},
                  lambda x, c, _: {out: lists(fuzzy_u(sqdist(x, c), m))})
