"""K-means and fuzzy c-means over sparse points (A1 with B3-B6, C8, C9, C11).

The same passes as over dense rows, by non-zeros: a task adds up the non-zeros
of its rows by (cluster, index), and Spark totals them.  No array of the dimension's length exists anywhere, so a bag of
words over the whole vocabulary is clustered as it is.

Centres are a table of their non-zeros (cluster, index, value).  Rows are dealt
into blocks (``blocks.Blocks``), and a block fetches the centre values of its
own indices; the driver sees k weights, costs and shifts a pass.

Distances are |x|^2 - 2 x.c + |c|^2: rows much closer to a centre than their
norm keep fewer digits than in the dense kernel's direct differences.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import BLOCK_CELLS, fuzzy_u
from ..functions.scoring import lists
from ..functions.sparse import CenterTable, PlaceSums, SparseCenters, csr, row_blocks
from ..session import cut_lineage, spread
from ..sources.sparse import INDICES, VALUES, validate
from .blocks import Blocks, Entries, numbers, totals
from .packed import Runs
from .fuzzy import _check_m

#: Places of a cluster's weight and cost among its sums.
WEIGHT, COST = -1, -2
CELLS = "cluster int, index int, value double"


def group_means(points: DataFrame, group: Column) -> tuple[DataFrame, int]:
    """(cluster, index, value) of each group's mean, groups numbered 0.. in order, and their number."""
    rows = points.select(group.alias("_g"), INDICES, VALUES)
    sizes = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).orderBy("_g").collect()  # k rows
    numbered = points.sparkSession.createDataFrame(
        [(r["_g"], j, r["_n"]) for j, r in enumerate(sizes)], f"_g {rows.schema['_g'].dataType.simpleString()}, cluster int, _n long")

    def run(batches):
        sums = PlaceSums()
        for b in batches:
            offsets, index, value = csr(b, INDICES, VALUES)
            sums.add(np.repeat(numbers(b.column(0)), np.diff(offsets)), index, value)
        yield from sums.batches()

    own = rows.join(F.broadcast(numbered), "_g").select("cluster", INDICES, VALUES)
    sums = totals(own.mapInArrow(run, CELLS), ["cluster", "index"], F.sum("value").alias("s"))
    return (sums.join(F.broadcast(numbered), "cluster").select("cluster", "index", (F.col("s") / F.col("_n")).alias("value")),
            len(sizes))


def init_random(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(cluster, index, value) of k distinct rows, the first by a hash of the row and the seed."""
    rows = points.select(INDICES, VALUES).distinct()
    first = rows.orderBy(F.xxhash64(F.lit(seed), INDICES, VALUES), INDICES, VALUES).limit(k).collect()
    if len(first) < k:
        raise ValueError(f"need {k} distinct rows, table has {len(first)}")
    return points.sparkSession.createDataFrame(
        [(j, int(i), float(v)) for j, r in enumerate(first) for i, v in zip(r[0], r[1])], "cluster int, index int, value double")


def deal(points: DataFrame, entries: int | None = None) -> Blocks:
    """Points in blocks, by a hash of the whole row; ``entries``: their non-zeros, if known."""
    return Blocks.deal(points.select("id", INDICES, VALUES), F.xxhash64("id", INDICES, VALUES), INDICES, entries=entries)


def _over_blocks(dealt: Blocks, centers: CenterTable, schema: str, fn) -> DataFrame:
    """fn(a block's runs of rows, the centres at its indices) -> tables of ``schema``."""
    k, squares = centers.k, centers.squares()
    by_place = centers.table.groupBy("index").agg(
        F.collect_list(F.struct("cluster", "value")).alias("c")).select("index", "c.cluster", "c.value")

    def run(held: Runs, there: pa.Table):
        lists = there.column("cluster").combine_chunks()
        index = np.repeat(numbers(there.column("index")), numbers(lists.value_lengths()))
        near = SparseCenters(k, numbers(lists.flatten()), index, numbers(there.column("value").combine_chunks().flatten()))
        near.squares = squares
        yield from fn(held, near)

    return dealt.map_runs(dealt.fetch(by_place, "index"), schema, run)


def _rows(own: pa.Table, k: int):
    """(first row, end row, offsets, indices, values) of runs of a block's rows."""
    cells = Entries(own, INDICES, VALUES)
    offsets = np.append(0, cells.ends)
    for s, e in row_blocks(offsets, k):
        part = slice(offsets[s], offsets[e])
        yield s, e, offsets[s:e + 1] - offsets[s], cells.place[part], cells.value[part]


def _scored(points: DataFrame, centers: SparseCenters | CenterTable, schema: str, columns) -> DataFrame:
    """id + the columns that ``columns`` makes of a run of rows' squared distances."""
    table = CenterTable.of(centers, points.sparkSession)

    def run(held: Runs, near: SparseCenters):
        for own in held:
            ids = own.column("id").combine_chunks()
            for s, e, offsets, index, value in _rows(own, near.k):
                yield pa.Table.from_arrays([ids.slice(s, e - s), *columns(near.sqdist(offsets, index, value))], names=names)

    schema = f"id {points.schema['id'].dataType.simpleString()}, {schema}"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    return _over_blocks(deal(points), table, schema, run)


def assign(points: DataFrame, centers: SparseCenters | CenterTable) -> DataFrame:
    """Id, cluster (lowest index on ties) and dist2."""
    def columns(dist):
        best = np.argmin(dist, axis=1)
        return pa.array(best.astype(np.int32)), pa.array(dist[np.arange(len(dist)), best])

    return _scored(points, centers, "cluster int, dist2 double", columns)


def memberships(points: DataFrame, centers: SparseCenters | CenterTable, m: float) -> DataFrame:
    """Id and u ARRAY<DOUBLE> (sums to 1)."""
    _check_m(m)
    return _scored(points, centers, "u array<double>", lambda dist: (lists(fuzzy_u(dist, m)),))


def step_sums(dealt: Blocks, centers: CenterTable, m: float | None = None) -> DataFrame:
    """(cluster, index, value) sums of w x, and of w (index WEIGHT) and
    w dist2 (COST); w is 1 for the nearest centre, or u^m for all of them."""
    def run(held: Runs, c: SparseCenters):
        sums, full = PlaceSums(), FullSums(c) if c.full is not None else None
        own = np.arange(c.k)
        for s, e, o, i, v in (x for rows in held for x in _rows(rows, c.k)):
            dist = c.sqdist(o, i, v)
            row = np.repeat(np.arange(e - s), np.diff(o))
            if m is None:
                best = np.argmin(dist, axis=1)
                weight, cost = np.bincount(best, minlength=c.k), np.bincount(best, dist[np.arange(e - s), best], c.k)
            else:
                um = fuzzy_u(dist, m) ** m
                weight, cost = um.sum(axis=0), (um * dist).sum(axis=0)
            if full:
                row, i, v = full.add(best if m is None else um, row, i, v)
            if m is None:
                sums.add(best[row], i, v)
            else:
                _add_all(sums, um, row, i, v)
            sums.add(own, np.full(c.k, WEIGHT), weight.astype(np.float64))
            sums.add(own, np.full(c.k, COST), cost)
        if full:
            for b in full.batches():
                yield pa.Table.from_batches([b])
        for b in sums.batches():
            yield pa.Table.from_batches([b])

    return totals(_over_blocks(dealt, centers, CELLS, run), ["cluster", "index"], F.sum("value").alias("value"))


class FullSums:
    """Sums by (cluster, place) of the places that the centres have."""

    def __init__(self, c: SparseCenters):
        self.c, self.sums = c, np.zeros(c.full.shape)

    def add(self, by: np.ndarray, row: np.ndarray, index: np.ndarray, value: np.ndarray):
        """Entries count in the cluster ``by`` row, or by its weights in all of them; those of other places are left."""
        k, n = self.sums.shape
        at = self.c.at(index)
        met = at >= 0
        own, place, number = row[met], at[met], value[met]
        if by.ndim == 1:
            self.sums += np.bincount(by[own] * n + place, number, k * n).reshape(k, n)
        else:
            for j in range(k):
                self.sums[j] += np.bincount(place, by[own, j] * number, n)
        return row[~met], index[~met], value[~met]

    def batches(self, size: int = 1 << 16):
        for j, sums in enumerate(self.sums):
            live = np.flatnonzero(sums)
            for s in range(0, len(live), size):
                at = live[s:s + size]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), j, np.int32)), pa.array(self.c.places[at].astype(np.int32)), pa.array(sums[at])],
                                                 names=["cluster", "index", "value"])


def _add_all(sums: PlaceSums, um: np.ndarray, row: np.ndarray, index: np.ndarray, value: np.ndarray) -> None:
    """Every entry counts in every cluster: added up by index first, some entries at a time."""
    k = um.shape[1]
    order = np.argsort(index, kind="stable")
    step = max(1, BLOCK_CELLS // k)
    for s in range(0, len(order), step):
        at = order[s:s + step]
        places, first = np.unique(index[at], return_index=True)
        total = np.add.reduceat(um[row[at]] * value[at][:, None], first, axis=0)
        sums.add(np.tile(np.arange(k), len(places)), np.repeat(places, k), total.reshape(-1))


def update(centers: CenterTable, sums: DataFrame) -> tuple[CenterTable, np.ndarray, np.ndarray, float]:
    """(new centres, squared shifts, weights, cost under the old centres).

    A cluster without weight keeps its centre."""
    k, spark = centers.k, sums.sparkSession
    total = cut_lineage(sums)
    weight, cost = np.zeros(k), 0.0
    for r in total.where(F.col("index") < 0).collect():  # 2k rows
        if r["index"] == WEIGHT:
            weight[r["cluster"]] = r["value"]
        else:
            cost += r["value"]
    weights = F.broadcast(spark.createDataFrame(list(enumerate(weight.tolist())), "cluster int, _w double"))
    moved = (total.where(F.col("index") >= 0).join(weights.where("_w > 0"), "cluster")
             .select("cluster", "index", (F.col("value") / F.col("_w")).alias("value")).where("value <> 0"))
    kept = centers.table.join(weights.where("_w <= 0"), "cluster").select("cluster", "index", "value")
    new = CenterTable(k, cut_lineage(moved.unionAll(kept)))
    shifts = (new.table.unionAll(centers.table.withColumn("value", -F.col("value"))).groupBy("cluster", "index")
              .agg(F.sum("value").alias("v")).groupBy("cluster").agg(F.sum(F.col("v") * F.col("v")).alias("s")))
    shift2 = np.zeros(k)
    for r in shifts.collect():  # k rows
        shift2[r["cluster"]] = r["s"]
    return new, shift2, weight, cost


@dataclass
class SparseModel:
    table: CenterTable
    m: float | None = None
    trace: list = field(default_factory=list)

    @property
    def centers(self) -> SparseCenters:
        """The centres as arrays, if they are few enough to hold."""
        return SparseCenters.from_table(self.table.table, self.table.k)

    def centers_df(self, spark: SparkSession) -> DataFrame:
        return self.table.table

    def predict(self, points: DataFrame) -> DataFrame:
        """Id and prediction, the centre of least distance (of largest membership, too)."""
        return assign(points, self.table).select("id", F.col("cluster").alias("prediction"))


def _train(points: DataFrame, k: int, init, m, max_iter, epsilon, seed) -> SparseModel:
    data = spread(points.select("id", INDICES, VALUES))
    stats = validate(data)
    if stats.rows == 0:
        raise ValueError("points table holds no row")
    dealt = deal(data, stats.nonzeros)
    try:
        table = init if isinstance(init, DataFrame) else init_random(dealt.rows, k, seed)
        model = SparseModel(CenterTable(k, cut_lineage(CenterTable.cells(table))), m)
        for it in range(1, max_iter + 1):
            t0 = time.time()
            model.table, shift2, _, cost = update(model.table, step_sums(dealt, model.table, m))
            model.trace.append(dict(iteration=it, value=cost, max_shift=float(np.sqrt(shift2.max())), seconds=time.time() - t0))
            if (shift2 <= epsilon * epsilon).all():
                break
        return model
    finally:
        dealt.unpersist()


def train_kmeans(points: DataFrame, k: int, init="random", max_iter: int = 20, epsilon: float = 1e-4, seed: int = 0) -> SparseModel:
    """C1 over sparse points; ``init``: "random" or a (cluster, index, value) table."""
    return _train(points, k, init, None, max_iter, epsilon, seed)


def train_fuzzy(points: DataFrame, k: int, m: float = 2.0, init="random", max_iter: int = 20, epsilon: float = 1e-4,
                seed: int = 0) -> SparseModel:
    """B1 over sparse points."""
    _check_m(m)
    return _train(points, k, init, m, max_iter, epsilon, seed)
