"""Gaussian mixture for wide rows: the model is a table and never on the driver.

A component of d dimensions has d*d numbers, so k of them soon outgrow a
driver.  Here the components stay a written table of one row each:

* Rows are dealt once into blocks of bounded bytes.  A step brings a copy of
  the component table to every block (``cogroup``) and a block answers with its
  sums of responsibilities, first and second moments, the second moments in
  blocks of ``ROWS`` matrix rows.
* The sums of one (component, row block) are added up in one place, and a
  component's row blocks meet in one group, which makes its mean, covariance,
  root of the pseudo-inverse and log normaliser: the next table.

The driver sees the total of the responsibilities and the log likelihood.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import batch_matrix
from ..session import cut_lineage
from ..sources import points as P
from .mixture import Mixture, gaussian_constants, responsibilities

#: Rows of a second-moment matrix that are summed as one array.
ROWS = 64
#: Bytes of rows in a block, about.
BLOCK_BYTES = 64 << 20
MODEL = "component int, s double, mu array<double>, sigma array<double>, root array<double>, log_norm double"
PARTS = "component int, part int, values array<double>"


def _finished(component: int, s: float, mu: np.ndarray, sigma: np.ndarray) -> dict:
    root, log_norm = gaussian_constants(mu, sigma)
    return {"component": [component], "s": [s], "mu": [mu.tolist()], "sigma": [sigma.ravel().tolist()],
            "root": [root.ravel().tolist()], "log_norm": [log_norm]}


def model_table(components: DataFrame) -> DataFrame:
    """The (component, weight, mu, sigma) table with each one's root and log normaliser."""
    def finish(batches):
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_pydict(_finished(
                    r["component"], r["weight"], np.array(r["mu"]), np.reshape(r["sigma"], (len(r["mu"]), -1))), schema=model)

    model = _arrow(MODEL)
    return components.select("component", "weight", "mu", "sigma").repartition("component").mapInArrow(finish, MODEL)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in ddl.split(", "))])


def _moments(left: pa.Table, right: pa.Table, features: str, d: int, total: float) -> pa.Table:
    """One block's sums: part -1 holds [s, sum p x], part r the matrix rows from r * ROWS."""
    if not left.num_rows:
        return _arrow(PARTS).empty_table()
    x = batch_matrix(left.combine_chunks().to_batches()[0], features, d)
    right = right.combine_chunks().sort_by("component").to_pydict()
    k = len(right["component"])
    mix = Mixture(np.array(right["s"]) / total, np.array(right["mu"]), np.empty((k, 0, 0)))
    p, logs = responsibilities(x, mix, [(np.array(root).reshape(d, d), u) for root, u in zip(right["root"], right["log_norm"])])
    out = [(k, -1, np.array([logs.sum()]))]
    for j, c in enumerate(right["component"]):
        out.append((c, -1, np.concatenate([[p[:, j].sum()], p[:, j] @ x])))
        out += [(c, r // ROWS, (x[:, r:r + ROWS] * p[:, j:j + 1]).T @ x) for r in range(0, d, ROWS)]
    return pa.table({"component": [o[0] for o in out], "part": [o[1] for o in out],
                     "values": [o[2].ravel() for o in out]}, schema=_arrow(PARTS))


def _added(parts: DataFrame) -> DataFrame:
    """One array per (component, part), added up as they stream in."""
    def run(batches):
        acc = {}
        for b in batches:
            ends = b.column(2).offsets.to_numpy()
            flat = b.column(2).values.to_numpy()
            for c, part, s, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ends, ends[1:]):
                acc[c, part] = acc[c, part] + flat[s:e] if (c, part) in acc else flat[s:e].copy()
        for (c, part), values in acc.items():
            yield pa.RecordBatch.from_pydict({"component": [c], "part": [part], "values": [values]}, schema=_arrow(PARTS))

    return parts.repartition("component", "part").mapInArrow(run, PARTS)


def _maximised(table: pa.Table, d: int) -> pa.Table:
    """One component's new row of the model table, from its parts."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("part", "values"))))
    s, mu = rows[0][1][0], np.array(rows[0][1][1:]) / rows[0][1][0]
    sxx = np.concatenate([np.reshape(v, (-1, d)) for _, v in rows[1:]])
    return pa.Table.from_pydict(_finished(table["component"][0].as_py(), s, mu, sxx / s - np.outer(mu, mu)), schema=_arrow(MODEL))


@dataclass
class TableMixture:
    model: DataFrame  # MODEL, written
    total: float  # of s
    trace: list = field(default_factory=list)

    def components(self) -> DataFrame:
        """(component, weight, mu, sigma) as ``mixture.Mixture.to_df`` gives it."""
        d = F.size("mu")
        rows = F.transform(F.sequence(F.lit(0), d - 1), lambda i: F.slice("sigma", i * d + 1, d))
        return self.model.select("component", (F.col("s") / self.total).alias("weight"), "mu", rows.alias("sigma"))


def deal(points: DataFrame, features: str = P.FEATURES, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int, int]:
    """(rows with their block, number of blocks, d); kept in memory, a block in one place."""
    points = cut_lineage(P.clean(points.select(features), features))
    stats = P.validate(points, features)
    blocks = max(-(-stats.rows * stats.dim * 8 // block_bytes), int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # By a number of the row, not by its content, so that equal rows are spread too.
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    dealt = points.withColumn("block", block).repartition(blocks, "block").persist(StorageLevel.MEMORY_AND_DISK)
    return dealt, blocks, stats.dim


def em_step(dealt: DataFrame, blocks: int, d: int, mix: TableMixture, features: str = P.FEATURES) -> tuple[TableMixture, float]:
    """(new mixture, log likelihood under the old one)."""
    total, finish = mix.total, lambda table: _maximised(table, d)
    copies = mix.model.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(blocks, "block")
    parts = dealt.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(
        lambda left, right: _moments(left, right, features, d, total), PARTS)
    sums = cut_lineage(_added(parts))
    firsts = sums.where("part = -1").select("component", F.col("values")[0].alias("s")).collect()  # k + 1 numbers
    k = len(firsts) - 1
    llh = next(r["s"] for r in firsts if r["component"] == k)
    new = cut_lineage(sums.where(F.col("component") < k).groupBy("component").applyInArrow(finish, MODEL))
    return TableMixture(new, math.fsum(r["s"] for r in firsts if r["component"] < k)), llh


def train(points: DataFrame, init: DataFrame, max_iter: int = 100, tol: float = 0.01, features: str = P.FEATURES,
          block_bytes: int = BLOCK_BYTES) -> TableMixture:
    """E1/E4 from a (component, weight, mu, sigma) table."""
    dealt, blocks, d = deal(points, features, block_bytes)
    try:
        flat = init.withColumn("sigma", F.flatten("sigma"))
        model = cut_lineage(model_table(flat))
        mix = TableMixture(model, model.agg(F.sum("s")).first()[0])
        llh, llhp, it, trace = -np.finfo(float).max, 0.0, 0, []
        while it < max_iter and abs(llh - llhp) > tol:
            t0 = time.time()
            mix, cur = em_step(dealt, blocks, d, mix, features)
            llhp, llh = llh, cur
            it += 1
            trace.append(dict(iteration=it, llh=cur, seconds=time.time() - t0))
        mix.trace = trace
        return mix
    finally:
        dealt.unpersist()
