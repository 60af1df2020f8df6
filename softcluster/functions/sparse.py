"""Kernels for sparse rows: CSR from Arrow lists, distances to sparse centres, sums.

Centres are held by index: for every index that occurs in a centre, the
clusters and values there.  Distances and sums touch non-zeros alone, and
memory follows them, never the dimension.  A ``CenterTable`` holds any number
of non-zeros; ``SparseCenters`` those that a task needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .centers import MAX_STATE_VALUES
from .kernels import BLOCK_CELLS

#: Values of centres held by (cluster, place).
FULL_CELLS = 1 << 23
#: Entries that a task's sums hold before equal places are added up.
MERGE_AT = 1 << 20
CENTER_SCHEMA = T.StructType([T.StructField("cluster", T.IntegerType(), False), T.StructField("index", T.IntegerType(), False),
                              T.StructField("value", T.DoubleType(), False)])


def csr(batch: pa.RecordBatch, indices: str, values: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row offsets, indices, values) of an Arrow batch of list columns."""
    i, v = (batch.column(batch.schema.get_field_index(c)) for c in (indices, values))
    offsets = i.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], i.flatten().to_numpy(), v.flatten().to_numpy()


class SparseCenters:
    """k centres by their non-zeros (cluster, index, value), each place once."""

    def __init__(self, k: int, cluster: np.ndarray, index: np.ndarray, value: np.ndarray):
        live = value != 0
        cluster, index, value = cluster[live], index[live], value[live]
        order = np.lexsort((cluster, index))
        self.k = k
        self.cluster, self.index, self.value = cluster[order].astype(np.int64), index[order].astype(np.int64), value[order]
        self.places, first = np.unique(self.index, return_index=True)
        self.offsets = np.append(first, len(self.index))
        self.squares = np.bincount(self.cluster, weights=self.value ** 2, minlength=k)
        cells = k * len(self.places)
        self.full = None
        if 0 < cells <= FULL_CELLS and 2 * len(self.value) >= cells:
            self.full = np.zeros((k, len(self.places)))
            self.full[self.cluster, np.repeat(np.arange(len(self.places)), np.diff(self.offsets))] = self.value

    def at(self, index: np.ndarray) -> np.ndarray:
        """Where each index stands among the places; -1 where it does not."""
        if not len(self.places):
            return np.full(len(index), -1)
        at = np.minimum(np.searchsorted(self.places, index), len(self.places) - 1)
        return np.where(self.places[at] == index, at, -1)

    @classmethod
    def from_table(cls, table: DataFrame, k: int) -> "SparseCenters":
        """Of a (cluster, index, value) table; its size is checked first."""
        if (n := table.count()) > MAX_STATE_VALUES:
            raise ValueError(f"{n} non-zeros are too many to hold as model state")
        t = table.select("cluster", "index", "value").toArrow()
        return cls(k, *(t[c].to_numpy() for c in ("cluster", "index", "value")))

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(pa.table({
            "cluster": pa.array(self.cluster.astype(np.int32)), "index": pa.array(self.index.astype(np.int32)),
            "value": pa.array(self.value)}), CENTER_SCHEMA)

    def dots(self, offsets: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """(rows, k) inner products."""
        n = len(offsets) - 1
        row = np.repeat(np.arange(n), np.diff(offsets))
        out = np.zeros(n * self.k)
        if not len(self.places):
            return out.reshape(n, self.k)
        if self.full is not None:  # nearly every place is in every centre
            at = self.at(index)
            met = np.flatnonzero(at >= 0)
            row, at, value = row[met], at[met], value[met]
            return np.column_stack([np.bincount(row, value * c[at], n) for c in self.full])
        step = max(1, BLOCK_CELLS // self.k)  # an entry meets at most k centre values
        for s in range(0, len(index), step):
            at = np.searchsorted(self.places, index[s:s + step])
            at[at == len(self.places)] = 0
            met = np.flatnonzero(self.places[at] == index[s:s + step])
            at = at[met]
            many = self.offsets[at + 1] - self.offsets[at]
            ends = np.cumsum(many)
            flat = np.arange(many.sum()) + np.repeat(self.offsets[at] - ends + many, many)
            key = np.repeat(row[s:s + step][met], many) * self.k + self.cluster[flat]
            out += np.bincount(key, weights=np.repeat(value[s:s + step][met], many) * self.value[flat], minlength=n * self.k)
        return out.reshape(n, self.k)

    def sqdist(self, offsets: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """(rows, k) squared distances |x|^2 - 2 x.c + |c|^2, never below 0."""
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        own = np.bincount(row, weights=value * value, minlength=len(offsets) - 1)
        return np.maximum(own[:, None] - 2 * self.dots(offsets, index, value) + self.squares, 0.0)


@dataclass
class CenterTable:
    """k centres as a table (cluster, index, value) of their non-zeros."""
    k: int
    table: DataFrame

    @classmethod
    def of(cls, centers: "SparseCenters | CenterTable", spark) -> "CenterTable":
        return centers if isinstance(centers, cls) else cls(centers.k, centers.table(spark))

    @staticmethod
    def cells(table: DataFrame) -> DataFrame:
        return table.select(F.col("cluster").cast("int"), F.col("index").cast("int"), F.col("value").cast("double")).where("value <> 0")

    def squares(self) -> np.ndarray:
        """|c|^2 of every centre."""
        out = np.zeros(self.k)
        for r in self.table.groupBy("cluster").agg(F.sum(F.col("value") * F.col("value")).alias("s")).collect():
            out[r["cluster"]] = r["s"]
        return out


def row_blocks(offsets: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose (rows, k) matrix stays within BLOCK_CELLS."""
    step = max(1, BLOCK_CELLS // (8 * max(1, k)))
    for s in range(0, len(offsets) - 1, step):
        yield s, min(s + step, len(offsets) - 1)


class PlaceSums:
    """Sums by (cluster, index) within a task, memory by distinct places."""

    def __init__(self):
        self.keys, self.values, self.n, self.limit = [], [], 0, MERGE_AT

    def add(self, cluster: np.ndarray, index: np.ndarray, value: np.ndarray) -> None:
        self.keys.append((cluster.astype(np.int64) << 32) + index)
        self.values.append(value)
        self.n += len(value)
        if self.n > self.limit:
            self.merge()
            self.limit = max(MERGE_AT, 2 * self.n)

    def merge(self) -> None:
        if self.keys:
            keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            self.values = [np.bincount(at, weights=np.concatenate(self.values), minlength=len(keys))]
            self.keys, self.n = [keys], len(keys)

    def batches(self, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        """(cluster, index, value) rows.  Index -1 and below are the caller's own sums."""
        self.merge()
        for keys, values in zip(self.keys, self.values):
            cluster = (keys + (1 << 31)) >> 32  # indices may be as low as -2**31
            for s in range(0, len(keys), size):
                part = slice(s, s + size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cluster[part].astype(np.int32)), pa.array((keys[part] - (cluster[part] << 32)).astype(np.int32)),
                     pa.array(values[part])], names=["cluster", "index", "value"])
