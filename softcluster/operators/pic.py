"""Power iteration clustering (F1-F7) on edge tables.

W = D^-1 A is kept as an edge table; one power step is
    v'(src) = sum over edges of w * v(dst)
i.e. a join of edges with v on dst and a partial+final aggregate on src
(map-side combine: a hot source vertex never lands whole in one task).
Edges are dealt once, by destination and, where a destination has many edges,
by block of sources too: such a vertex is spread over as many cells as its
edges fill, and the step's vector has a copy of it for each.  So no task holds
more edges than others, however hot a vertex is, and a step moves only the
vertex vector to the join.  Every step's vector is written as a table before
its parents go, so a step costs the same however many came before it, and a
lost executor replays one step.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import normal
from ..session import cut_lineage
from ..sources.edges import checked
from . import kmeans

EPSILON = 2.220446049250313e-16
DEFAULTS = dict(k=2, max_iter=100, init="random")
#: Cells of edges per shuffle partition, and a cell's least number of edges.
CELLS, LEAST_CELL = 32, 4096


def normalize(edges: DataFrame, with_degrees: bool = False):
    """mirror every pair, drop self pairs (duplicates add up), then
    w = s / max(rowsum(src), EPS).  With ``with_degrees`` also returns the
    (id, degree) row sums, computed once and reused by the degree start."""
    both = _mirrored(edges)
    return _row_normalize(both, with_degrees)


def normalize_directed(edges: DataFrame, with_degrees: bool = False):
    """a given directed graph, row-normalised as is (self edges dropped,
    quirk Q15)."""
    return _row_normalize(checked(edges).where(F.col("src") != F.col("dst")), with_degrees)


def _row_normalize(e: DataFrame, with_degrees: bool = False):
    # One checkpointed table: the row sums and the weights both read it.
    e = cut_lineage(e)
    rows = cut_lineage(e.groupBy("src").agg(F.sum("weight").alias("_rowsum")))
    w = e.join(rows, "src").select("src", "dst", (F.col("weight") / F.greatest(
        F.col("_rowsum"), F.lit(EPSILON))).alias("weight"))
    if with_degrees:
        return w, rows.select(F.col("src").alias("id"), F.col("_rowsum").alias("degree"))
    return w


def degrees(w: DataFrame) -> DataFrame:
    """Row sums of a (normalised or raw) edge table: (id, degree)."""
    return w.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree"))


def init_degree(a: DataFrame = None, degrees_df: DataFrame | None = None) -> DataFrame:
    """v0 = rowsum / total, over the mirrored affinity table ``a`` or
    from row sums already computed by ``normalize(..., with_degrees=True)``."""
    d = degrees_df if degrees_df is not None else degrees(a)
    total = d.agg(F.sum("degree")).first()[0]
    return d.select("id", (F.col("degree") / F.lit(total)).alias("v"))


def init_random(w: DataFrame, seed: int = 0) -> DataFrame:
    """a gaussian per vertex divided by the L1 norm, keyed by the vertex."""
    r = w.select(F.col("src").alias("id")).distinct().select("id", normal(seed, "id").alias("r"))
    total = r.agg(F.sum(F.abs("r"))).first()[0]
    return r.select("id", (F.col("r") / F.lit(total)).alias("v"))


@dataclass
class DealtEdges:
    """Edges (src, dst, cell, weight) partitioned by destination and cell."""

    edges: DataFrame
    hot: DataFrame  # (dst, cells) of the destinations of more than one cell

    def power_step(self, v: DataFrame) -> DataFrame:
        """v' = W v (unnormalised), as (id, v)."""
        cells = F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1)
        copies = (v.select(F.col("id").alias("dst"), F.col("v").alias("_v")).join(F.broadcast(self.hot), "dst", "left")
                  .select("dst", "_v", F.explode(cells).alias("cell")))
        return (self.edges.join(copies, ["dst", "cell"]).groupBy(F.col("src").alias("id"))
                .agg(F.sum(F.col("weight") * F.col("_v")).alias("v")))


def deal_edges(w: DataFrame, least_cell: int = LEAST_CELL) -> DealtEdges:
    """Edges dealt into cells of about 1/CELLS of a task's share of them.

    A destination of more edges than a cell holds is hot.  There are fewer hot
    ones than cells, CELLS times the shuffle partitions, which bounds the table
    that is broadcast.
    """
    spark = w.sparkSession
    w = cut_lineage(w)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = max(least_cell, w.count() // (CELLS * tasks))
    hot = cut_lineage(w.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
                      .select("dst", F.ceil(F.col("n") / cell).cast("int").alias("cells")))
    block = F.when(F.col("cells").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("src"), F.col("cells"))).cast("int")
    edges = w.join(F.broadcast(hot), "dst", "left").select("src", "dst", block.alias("cell"), "weight")
    return DealtEdges(edges.repartition(tasks, "dst", "cell").persist(StorageLevel.MEMORY_AND_DISK), hot)


def power_step(w: DataFrame, v: DataFrame) -> DataFrame:
    """v' = W v (unnormalised), as (id, v)."""
    vv = v.select(F.col("id").alias("_dst"), F.col("v").alias("_v"))
    return (w.join(vv, w["dst"] == vv["_dst"])
            .groupBy(F.col("src").alias("id"))
            .agg(F.sum(F.col("weight") * F.col("_v")).alias("v")))


@dataclass
class PowerResult:
    v: DataFrame
    iterations: int
    trace: list = field(default_factory=list)


def power_iteration(w: DataFrame, v0: DataFrame, max_iter: int = 100,
                    tol: float | None = None, fixed_steps: bool = False, least_cell: int = LEAST_CELL) -> PowerResult:
    """v' = Wv / |Wv|_1, delta = sum |v' - v|; stop when the change of
    delta <= max(1e-5/n, 1e-8) (unless ``fixed_steps``)."""
    dealt = deal_edges(w, least_cell)
    v = cut_lineage(v0)
    if tol is None:
        tol = max(1e-5 / v.count(), 1e-8)
    prev_delta, diff_delta = float("inf"), float("inf")
    trace, it = [], 0
    while it < max_iter and (fixed_steps or abs(diff_delta) > tol):
        t0 = time.time()
        raw = cut_lineage(dealt.power_step(v))
        norm = raw.agg(F.sum(F.abs("v"))).first()[0]
        new = raw.select("id", (F.col("v") / F.lit(norm)).alias("v"))
        if fixed_steps:
            delta = float("nan")  # only the stop rule needs it: one job saved
        else:
            delta = new.join(v.select("id", F.col("v").alias("_old")), "id").agg(
                F.sum(F.abs(F.col("_old") - F.col("v")))).first()[0] or 0.0
            diff_delta = abs(delta - prev_delta)
            prev_delta = delta
        it += 1
        v = new
        trace.append(dict(iteration=it, norm=float(norm), delta=float(delta), seconds=time.time() - t0))
    dealt.edges.unpersist()
    return PowerResult(v=v, iterations=it, trace=trace)


def assign(v: DataFrame, k: int, runs: int = 5, seed: int = 0, starts=None, max_iter: int = 20
           ) -> DataFrame:
    """k-means on the 1-d embedding (5 runs, seed 0; or one run from the
    given (k, 1) starts) -> (id, cluster)."""
    pts = v.select("id", F.array(F.col("v")).alias("features"))
    given = {} if starts is None else dict(init=starts, epsilon=0.0)
    model = kmeans.train(pts, k=k, runs=runs, seed=seed, max_iter=max_iter, **given)
    return kmeans.predict(pts, model.centers).select(
        "id", F.col("prediction").alias("cluster"))


def run(edges: DataFrame, k: int = DEFAULTS["k"], max_iter: int = DEFAULTS["max_iter"],
        init: str = DEFAULTS["init"], symmetric: bool = False, seed: int = 0,
        fixed_steps: bool = False, starts=None, kmeans_iter: int = 20) -> DataFrame:
    """edges -> (id, cluster).  ``symmetric=True`` takes the table as a
    directed graph (A4, F2); ``fixed_steps`` makes all ``max_iter`` steps;
    ``starts`` maps the embedding to k-means' first centres."""
    if init not in ("random", "degree"):
        raise ValueError(f"unknown init mode {init!r}")
    w, deg = (normalize_directed(edges, True) if symmetric else normalize(edges, True))
    v0 = init_degree(degrees_df=deg) if init == "degree" else init_random(w, seed)
    v = power_iteration(w, v0, max_iter, fixed_steps=fixed_steps).v
    return assign(v, k, starts=None if starts is None else starts(v), max_iter=kmeans_iter)


def _mirrored(edges: DataFrame) -> DataFrame:
    e = checked(edges)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.where(F.col("src") != F.col("dst"))
