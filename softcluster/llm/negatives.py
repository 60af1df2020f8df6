"""Hard-negative mining by a packed R-tree (operator 11).

An anchor's positives are the rows of its own label with the highest inner
products.  Its hard negatives for a positive are the rows of other labels that
score highest within a window below that positive's score.  Vectors hold
integers, so scores are exact.

1. Pack (sort-tile-recursive).  Rows are range-partitioned into slabs by label
   and the coordinate of largest variance, the slabs into tiles by the next
   coordinate; inside a tile the recursion goes on over the further ones.  Ids
   break ties, so equal vectors are cut like any others.  Tiles are written in
   packed order: any run of consecutive rows is a good box.
2. Anchors are numbered and taken in blocks of at most ``block_rows``, each one
   broadcast to a pass over the tiles.
3. In a task, rows become leaves of ``LEAF`` rows and levels of boxes above
   them.  A box has bounds per coordinate, hence an interval of inner products
   with the anchor, and the labels and least id inside it.  A queue takes boxes
   by their highest possible score; boxes outside every score window, with no
   label of the wanted kind, or strictly below the kth score found so far are
   left out (and those that only equal it, if no id inside is small enough).
4. A task gives at most k rows per window, and the best k of all tasks are the
   result: once for the positives, once for their negatives.

Results for odd rows: rows with a null id, label or vector, or with a null or
non-finite component, take no part.  Components beyond 2**22 count as 2**22.  A
vector shorter than the longest one ends in zeros.  Rows equal in id, label
and vector are one row; rows of one id that differ are rows (and anchors) of
their own, but no positives or negatives of each other.  An empty table, or
one without anchors, gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from softcluster.functions.kernels import partial_sums
from softcluster.functions.ranking import number_rows
from softcluster.llm.tables import written
from softcluster.session import scratch_table_dir

LEAF, FANOUT = 128, 16
#: Rows of a tile, which a task packs, and of a tree, which a task searches.
TILE_ROWS = 1 << 14
#: Anchors that are broadcast at once.
BLOCK_ROWS = 1 << 14
LARGEST = 1 << 22
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def integer_rows(rows: DataFrame, label: Column, vector: Column, scale: int = 256) -> DataFrame:
    """id, label and q (floor of scale times the component), of usable rows."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    usable = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    q = F.transform(doubles, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    return (rows.where(F.col("vec_id").isNotNull() & label.isNotNull() & vector.isNotNull() & usable)
            .select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), q.alias("q")))


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (batch.column(0).to_numpy(), batch.column(1).to_numpy(),
            batch.column(2).flatten().to_numpy().reshape(-1, dim) if dim else np.zeros((len(batch), 0), np.int32))


def _segments(batches, dim: int, size: int):
    """(ids, labels, vectors) of runs of rows, whole batches each."""
    held, n = [], 0
    for batch in batches:
        held.append(_matrix(batch, dim))
        n += batch.num_rows
        if n >= size:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


# --- Packing -----------------------------------------------------------------

def str_order(ids: np.ndarray, labels: np.ndarray, q: np.ndarray, dims: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The rows' packed order: label by label, slabs along one coordinate after the other."""
    out = []

    def tile(rows: np.ndarray, depth: int) -> None:
        pages = -(-len(rows) // leaf)
        left = len(dims) - depth
        if pages <= 1 or not left:
            out.append(rows)
            return
        slabs = max(2, math.ceil(pages ** (1 / left)))
        rows = rows[np.lexsort((ids[rows], q[rows, dims[depth]]))]
        size = -(-pages // slabs) * leaf
        for s in range(0, len(rows), size):
            tile(rows[s:s + size], depth + 1)

    by_label = np.lexsort((ids, labels))
    cuts = np.flatnonzero(np.diff(labels[by_label])) + 1
    for rows in np.split(by_label, cuts):
        tile(rows, 0)
    return np.concatenate(out)


def pack(points: DataFrame, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, int, bool]:
    """(tiles in packed order, dimension, whether doubles hold every score exactly).

    Equal rows meet in one tile, where one of them stays."""
    size = F.array_max(F.transform("q", lambda x: F.abs(x)))
    r = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("dim"), F.max(size).alias("largest")).first()
    dim = r["dim"] or 0
    zeros = F.array_repeat(F.lit(0), dim)
    points = points.withColumn("q", F.when(F.size("q") < dim, F.slice(F.concat("q", zeros), 1, dim)).otherwise(F.col("q")) if dim else F.col("q"))

    def moments(batch):
        q = _matrix(batch, dim)[2].astype(np.float64)
        return np.stack([q.sum(axis=0), (q * q).sum(axis=0)])

    sums, squares = partial_sums(points, (2, dim), moments) if dim else np.zeros((2, 0))
    n = max(1, r["n"])
    dims = np.argsort(-(squares / n - (sums / n) ** 2), kind="stable")[:dim]
    exact = dim * float(r["largest"] or 0) ** 2 < 2.0 ** 52  # no score or bound of a box is beyond

    tiles = -(-n // tile_rows)
    slabs = math.ceil(math.sqrt(tiles))
    first, second = (F.col("q")[int(d)] for d in (dims[0], dims[min(1, dim - 1)])) if dim else (F.lit(0), F.lit(0))
    rows = points.repartitionByRange(slabs, "label", first, "id").withColumn("slab", F.spark_partition_id())
    rows = rows.repartitionByRange(tiles, "slab", second, "id", "label").select("id", "label", "q")

    def run(batches):
        for ids, labels, q in _segments(batches, dim, 1 << 62):  # a partition: about tile_rows
            order = str_order(ids, labels, q, dims[2:])
            ids, labels, q = ids[order], labels[order], q[order]
            same = np.lexsort((*q.T[::-1], labels, ids))
            again = (np.diff(ids[same]) == 0) & (np.diff(labels[same]) == 0) & (np.diff(q[same], axis=0) == 0).all(axis=1)
            keep = np.ones(len(ids), bool)
            keep[same[1:][again]] = False
            ids, labels, q = ids[keep], labels[keep], q[keep]
            for s in range(0, len(ids), 8192):
                part = q[s:s + 8192]
                ends = np.arange(len(part) + 1, dtype=np.int32) * dim
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[s:s + 8192]), pa.array(labels[s:s + 8192]),
                     pa.ListArray.from_arrays(ends, pa.array(part.reshape(-1).astype(np.int32)))], names=["id", "label", "q"])

    return written(rows.mapInArrow(run, "id long, label long, q array<int>"), "rtree-tiles"), dim, exact


# --- Searching -----------------------------------------------------------------

class Tree:
    """Leaves of consecutive rows and levels of boxes above them."""

    def __init__(self, ids, labels, q, exact: bool, leaf: int = LEAF, fanout: int = FANOUT):
        self.ids, self.labels, self.leaf, self.fanout = ids, labels, leaf, fanout
        self.q = q.astype(np.float64 if exact else np.int64)
        lo, hi, least, l0, l1, step = self.q, self.q, ids, labels, labels, leaf
        self.levels = []  # leaves first: (hi | lo), (least id, first label, last label)
        while True:
            at = np.arange(0, len(least), step)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            least, l0, l1 = np.minimum.reduceat(least, at), np.minimum.reduceat(l0, at), np.maximum.reduceat(l1, at)
            self.levels.append((np.concatenate([hi, lo], axis=1), least, l0, l1))
            step = fanout
            if len(at) <= fanout:
                break

    def search(self, anchor: np.ndarray, own: int, label: int, same: bool, windows, found: list[list], k: int) -> int:
        """Adds to ``found`` (per window, the best k as (-score, id), sorted)
        this tree's rows; returns the number of rows scored."""
        up, down = np.maximum(anchor, 0), np.minimum(anchor, 0)
        both = np.stack([np.concatenate([up, down]), np.concatenate([down, up])], axis=1).astype(self.q.dtype)
        anchor = anchor.astype(self.q.dtype)
        low, high = (np.array([w[i] for w in windows], np.int64) for i in (0, 1))
        floor, last = low.copy(), np.full(len(windows), np.iinfo(np.int64).max)
        highest, scored = int(high.max()), 0

        def tighten(w: int) -> None:
            if len(found[w]) == k:
                floor[w], last[w] = -found[w][-1][0], found[w][-1][1]

        for w in range(len(windows)):
            tighten(w)
        queue = []

        def push(level: int, a: int, b: int) -> None:
            boxes, least, l0, l1 = (x[a:b] for x in self.levels[level])
            bounds = (boxes @ both).astype(np.int64)
            top, bottom = bounds[:, :1], bounds[:, 1:]
            fits = (((top > floor) | ((top == floor) & (least[:, None] <= last))) & (bottom <= high)).any(axis=1)
            fits &= (l0 <= label) & (label <= l1) if same else (l0 != label) | (l1 != label)
            for i in np.flatnonzero(fits).tolist():
                heapq.heappush(queue, (-min(int(top[i, 0]), highest), level, a + i, int(top[i, 0])))

        root = len(self.levels) - 1
        push(root, 0, len(self.levels[root][1]))
        while queue:
            best, level, i, top = heapq.heappop(queue)
            if -best < floor.min():
                break  # every box left is strictly below
            if not ((top > floor) | ((top == floor) & (self.levels[level][1][i] <= last))).any():
                continue
            if level:
                push(level - 1, i * self.fanout, (i + 1) * self.fanout)
                continue
            a, b = i * self.leaf, (i + 1) * self.leaf
            scores = (self.q[a:b] @ anchor).astype(np.int64)
            scored += len(scores)
            ok = (self.labels[a:b] == label) == same
            ok &= (scores >= floor.min()) & (scores <= highest) & (self.ids[a:b] != own)
            if not ok.any():
                continue
            scores, ids = scores[ok], self.ids[a:b][ok]
            for w in range(len(windows)):
                inside = (scores >= floor[w]) & (scores <= high[w])
                if inside.any():
                    new = zip((-scores[inside]).tolist(), ids[inside].tolist())
                    found[w] = heapq.nsmallest(k, [*found[w], *new])
                    tighten(w)
        return scored


def _search(tiles: DataFrame, dim: int, exact: bool, block: dict, same: bool, k: int, tree_rows: int) -> DataFrame:
    """at, window, score, id: each task's best k rows of every window.

    ``block``: anchors' ids, labels, vectors and lists of windows."""
    shared = tiles.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        b = shared.value
        found = [[[] for _ in w] for w in b["windows"]]
        for ids, labels, q in _segments(batches, dim, tree_rows):
            tree = Tree(ids, labels, q, exact)
            for at, windows in enumerate(b["windows"]):
                if windows:
                    tree.search(b["q"][at], b["ids"][at], b["labels"][at], same, windows, found[at], k)
        rows = [(at, w, -s, i) for at, lists in enumerate(found) for w, best in enumerate(lists) for s, i in best]
        columns = zip(*rows) if rows else ([], [], [], [])
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["at", "window", "score", "id"])

    every = tiles.mapInArrow(run, "at int, window int, score long, id long")
    rank = F.row_number().over(Window.partitionBy("at", "window").orderBy(F.desc("score"), "id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(points: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   tile_rows: int = TILE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``points`` as given by :func:`integer_rows`; a negative's score lies between
    ``low`` and ``high`` hundredths of the positive's."""
    spark = points.sparkSession
    points = written(points, "rtree-rows")
    tiles, dim, exact = pack(points, tile_rows)
    numbered = number_rows(tiles.where(is_anchor), [F.col("id"), F.col("label"), F.col("q")], "at")
    anchors = scratch_table_dir(spark, f"rtree-anchors-{uuid.uuid4().hex}")
    numbered.withColumn("block", F.floor(F.col("at") / block_rows)).write.partitionBy("block").parquet(anchors)
    blocks = -(-numbered.count() // block_rows)
    out = scratch_table_dir(spark, f"rtree-negatives-{uuid.uuid4().hex}")
    for number in range(blocks):
        rows = (spark.read.schema(numbered.schema).parquet(f"{anchors}/block={number}").orderBy("at").toArrow().combine_chunks())
        ids, labels, q = _matrix(rows.to_batches()[0], dim)
        block = {"ids": ids.tolist(), "labels": labels.tolist(), "q": q}
        every = [[(-(1 << 62), 1 << 62)]] * len(ids)
        found = _search(tiles, dim, exact, block | {"windows": every}, True, positives, tile_rows).orderBy("at", "rank").toArrow()
        # Of one block: at most ``positives`` rows an anchor.
        own = [[] for _ in ids]
        for at, score, i in zip(*(found[c].to_pylist() for c in ("at", "score", "id"))):
            own[at].append((score, i))
        windows = [[(-(-low * s // 100), high * s // 100) for s, _ in pairs] for pairs in own]
        pairs = spark.createDataFrame(pa.table({
            "at": pa.array([at for at, p in enumerate(own) for _ in p], pa.int32()),
            "window": pa.array([w for p in own for w in range(len(p))], pa.int32()),
            "anchor_id": pa.array([block["ids"][at] for at, p in enumerate(own) for _ in p], pa.int64()),
            "positive_id": pa.array([i for p in own for _, i in p], pa.int64()),
            "positive_score": pa.array([s for p in own for s, _ in p], pa.int64())}))
        best = _search(tiles, dim, exact, block | {"windows": windows}, False, negatives, tile_rows)
        (best.join(F.broadcast(pairs), ["at", "window"])
         .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                 "positive_score", F.col("score").alias("negative_score"))
         .write.parquet(f"{out}/block={number}"))
    if not blocks:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*[f"{out}/block={number}" for number in range(blocks)])
