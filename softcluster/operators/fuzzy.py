"""Fuzzy c-means.

With d_j the squared distance from x to centre j:
    u_j = 1 / sum_l (d_j / d_l)^(1/(m-1))          (rows sum to 1)
    c_j = sum u_j^m x / sum u_j^m
A pass is one Spark job: an Arrow kernel emits per-partition sums
(sum u^m x, sum u^m, sum u^m d) per cluster, one tiny aggregate totals them,
and the k new centres come back to the driver for the next pass.  The points
table is persisted once; each pass builds a fresh plan, so lineage never grows.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import centers as C
from ..functions.columns import explode_clusters, first_argmax
from ..functions.draws import first_distinct, uniform
from ..functions.kernels import batch_matrix, fuzzy_u, partial_sums, sqdist
from ..functions.scoring import memberships
from ..sources import points as P

DEFAULTS = dict(k=2, max_iter=20, epsilon=1e-4, m=2.0)


def _check_m(m: float) -> None:
    if not m > 1.0:
        raise ValueError(f"fuzziness m must be > 1, got {m}")


def step_sums(points: DataFrame, centers: np.ndarray, m: float,
              features: str = P.FEATURES, weight: str | None = None) -> np.ndarray:
    """B3 kernel: (k, d + 2) = [sum u^m x | sum u^m | sum u^m d] per cluster;
    (r, k, d + 2) for the (r, k, d) centres of r runs, all in one pass."""
    _check_m(m)
    runs = centers if centers.ndim == 3 else centers[None]
    r, k, d = runs.shape
    cols = [features] + ([weight] if weight else [])

    def batch(b):
        x = batch_matrix(b, features, d)
        out = np.empty((r, k, d + 2))
        for own, c in zip(out, runs):
            dist = sqdist(x, c)
            um = fuzzy_u(dist, m) ** m
            if weight:
                um = um * np.asarray(b.column(1).to_numpy(zero_copy_only=False),
                                     dtype=np.float64)[:, None]
            own[:, :d] = um.T @ x
            own[:, d] = um.sum(axis=0)
            own[:, d + 1] = (um * dist).sum(axis=0)
        return out.reshape(r * k, d + 2)

    sums = partial_sums(points.select(*cols), (r * k, d + 2), batch).reshape(r, k, d + 2)
    return sums if centers.ndim == 3 else sums[0]


def update(centers: np.ndarray, sums: np.ndarray):
    """Divide; a cluster with zero weight keeps its centre.

    Returns (new_centers, max squared shift, objective under old centres).
    """
    d = centers.shape[1]
    w = sums[:, d]
    new = centers.copy()
    live = w > 0
    new[live] = sums[live, :d] / w[live, None]
    shift2 = np.sum((new - centers) ** 2, axis=1)
    return new, shift2, float(sums[:, d + 1].sum())


@dataclass
class FuzzyCMeansModel:
    centers: np.ndarray
    m: float
    epsilon: float = DEFAULTS["epsilon"]
    trace: list = field(default_factory=list)

    @property
    def k(self) -> int:
        return self.centers.shape[0]

    def centers_df(self, spark: SparkSession) -> DataFrame:
        return C.to_df(spark, self.centers)

    def trace_df(self, spark: SparkSession) -> DataFrame:
        return trace_df(spark, self.trace)

    def membership(self, points: DataFrame, keep=(), features: str = P.FEATURES,
                   long: bool = True) -> DataFrame:
        return membership(points, self.centers, self.m, keep=keep,
                          features=features, long=long)

    def predict(self, points: DataFrame, features: str = P.FEATURES,
                out: str = "prediction") -> DataFrame:
        return predict(points, self.centers, self.m, features=features, out=out)

    def objective(self, points: DataFrame, features: str = P.FEATURES) -> float:
        return objective(points, self.centers, self.m, features)


TRACE_SCHEMA = T.StructType([
    T.StructField("iteration", T.IntegerType(), False),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("max_shift", T.DoubleType(), True),
    T.StructField("seconds", T.DoubleType(), True),
])


def trace_df(spark: SparkSession, trace: list) -> DataFrame:
    return spark.createDataFrame(
        [(int(t["iteration"]), float(t["value"]), float(t["max_shift"]),
          float(t["seconds"])) for t in trace], TRACE_SCHEMA)


def init_random(points: DataFrame, k: int, seed: int = 0, features: str = P.FEATURES, key=None) -> np.ndarray:
    """B2: k distinct rows drawn at random (quirk Q4: never duplicates).

    Draws are keyed by the row's values (or a column ``key`` made of them), and
    equal rows are aggregated before any reaches the driver, which sees k rows.
    """
    rows = first_distinct(points, [features], k, seed, key)
    if len(rows) < k:
        raise ValueError(f"only {len(rows)} distinct rows for k={k}")
    return np.array([r[0] for r in rows], dtype=np.float64)


def train(points: DataFrame, k: int = DEFAULTS["k"], m: float = DEFAULTS["m"],
          max_iter: int = DEFAULTS["max_iter"], epsilon: float = DEFAULTS["epsilon"],
          init="random", seed: int = 0, runs: int = 1,
          features: str = P.FEATURES, weight: str | None = None) -> FuzzyCMeansModel:
    """B1: fuzzy c-means.  ``init`` = "random", "k-means||", a numpy array or
    a centres DataFrame.  With ``runs`` > 1 or a (r, k, d) array (B7) all runs
    share their passes and the one of the lowest fuzzy objective sum u^m d
    wins."""
    _check_m(m)
    if k < 1 or runs < 1:
        raise ValueError("k and runs must be >= 1")
    data, _ = P.prepare(points.select(
        *([features] + ([weight] if weight else []))), features)
    try:
        starts = _starts(data, k, init, seed, runs, features)
        models = _lloyd_fuzzy(data, starts, m, max_iter, epsilon, features, weight)
        if len(models) == 1:  # nothing to compare: no scoring pass
            return models[0]
        final = step_sums(data, np.stack([x.centers for x in models]), m, features, weight)
        return models[int(np.argmin(final[:, :, -1].sum(axis=1)))]
    finally:
        data.unpersist()


def _starts(data, k, init, seed, runs, features) -> np.ndarray:
    """(r, k, d) start centres."""
    if isinstance(init, np.ndarray) and init.ndim == 3:
        if init.shape[1] != k:
            raise ValueError("initial centres must have k rows")
        return np.asarray(init, dtype=np.float64)
    if isinstance(init, str) and init == "k-means||":
        from .kmeans import init_parallel_runs
        return init_parallel_runs(data, k, runs, seed=seed, features=features)
    return np.stack([_initial(data, k, init, seed + r, features) for r in range(runs)])


def _initial(data, k, init, seed, features):
    if isinstance(init, DataFrame):
        return C.from_df(init, k)
    if isinstance(init, np.ndarray):
        if init.shape[0] != k:
            raise ValueError("initial centres must have k rows")
        return np.asarray(init, dtype=np.float64)
    if init == "random":
        return init_random(data, k, seed, features)
    raise ValueError(f"unknown init mode {init!r}")


def _lloyd_fuzzy(data, starts, m, max_iter, epsilon, features, weight) -> list[FuzzyCMeansModel]:
    """All runs advance in one pass; a run whose centres rest drops out."""
    models = [FuzzyCMeansModel(centers=c, m=m, epsilon=epsilon) for c in starts]
    moving = models
    for it in range(1, max_iter + 1):
        if not moving:
            break
        t0 = time.time()
        sums = step_sums(data, np.stack([x.centers for x in moving]), m, features, weight)
        still = []
        for model, own in zip(moving, sums):
            # quirk Q7: the final pass's centres are kept
            model.centers, shift2, obj = update(model.centers, own)
            model.trace.append(dict(iteration=it, value=obj, max_shift=float(np.sqrt(shift2.max())),
                                    seconds=time.time() - t0))
            if np.any(shift2 > epsilon * epsilon):
                still.append(model)
        moving = still
    return models


def center_step(points: DataFrame, centers: np.ndarray, m: float,
                features: str = P.FEATURES) -> DataFrame:
    """B3 as a table: (cluster, weight, center) after one pass."""
    spark = points.sparkSession
    sums = step_sums(points, centers, m, features)
    new, _, _ = update(centers, sums)
    d = centers.shape[1]
    return C.to_df(spark, new, weight=sums[:, d])


def center_step_columns(points: DataFrame, centers: np.ndarray, m: float,
                        features: str = P.FEATURES) -> DataFrame:
    """B3 readable twin: memberships per row, exploded to (cluster, u^m), then
    one partial+final aggregate per cluster."""
    k, d = centers.shape
    wide = memberships(points, features, centers, m, [features])
    long = explode_clusters(wide, [features], k).select(
        features, "cluster", F.pow("u", F.lit(m)).alias("um"))
    agg = long.groupBy("cluster").agg(
        F.sum("um").alias("weight"),
        *[F.sum(F.col("um") * F.col(features)[i]).alias(f"s{i}") for i in range(d)])
    return agg.select(
        F.col("cluster").cast("int").alias("cluster"), "weight",
        F.array(*[F.col(f"s{i}") / F.col("weight") for i in range(d)]).alias("center"))


def center_shift(old: DataFrame, new: DataFrame, epsilon: float) -> DataFrame:
    """Per-cluster squared shift and the moved flag (shift^2 > eps^2).

    A cluster missing from ``new`` (no weight) keeps its old centre.
    """
    j = old.alias("o").join(new.alias("n"), "cluster", "left")
    moved_to = F.coalesce(F.col("n.center"), F.col("o.center"))
    shift2 = F.aggregate(F.zip_with(F.col("o.center"), moved_to, lambda a, b: (a - b) * (a - b)),
                         F.lit(0.0), lambda acc, x: acc + x)
    return j.select("cluster", moved_to.alias("center"), shift2.alias("shift2"),
                    (shift2 > epsilon * epsilon).alias("moved"))


def membership(points: DataFrame, centers: np.ndarray, m: float, keep=(),
               features: str = P.FEATURES, long: bool = True) -> DataFrame:
    """Soft assignment of every row.  Long form (keep.., cluster, u, u_m);
    wide form keeps ``u ARRAY<DOUBLE>`` (quirk Q2: both u and u^m are given)."""
    _check_m(m)
    wide = memberships(points, features, centers, m, list(keep) if long else [*keep, features])
    if not long:
        return wide
    return explode_clusters(wide, list(keep), len(centers)).select(
        *keep, "cluster", "u", F.pow("u", F.lit(m)).alias("u_m"))


def predict(points: DataFrame, centers: np.ndarray, m: float,
            features: str = P.FEATURES, out: str = "prediction", keep=None) -> DataFrame:
    """Index of the largest membership, lowest on ties."""
    keep = list(keep) if keep is not None else [c for c in points.columns if c != features]
    wide = memberships(points, features, centers, m, [*keep, features])
    return wide.withColumn(out, first_argmax(F.col("u"))).drop("u")


def objective(points: DataFrame, centers: np.ndarray, m: float,
              features: str = P.FEATURES) -> float:
    """B7 score: sum u^m d (the fuzzy objective)."""
    d = centers.shape[1]
    return float(step_sums(points, centers, m, features)[:, d + 1].sum())


def membership_delta(a: DataFrame, b: DataFrame, keys=("id",)) -> DataFrame:
    """Frobenius norm of U' - U, joined on (keys, cluster); one row."""
    on = list(keys) + ["cluster"]
    j = a.select(*on, F.col("u").alias("u1")).join(
        b.select(*on, F.col("u").alias("u2")), on, "full")
    diff = F.coalesce("u1", F.lit(0.0)) - F.coalesce("u2", F.lit(0.0))
    return j.agg(F.sqrt(F.sum(diff * diff)).alias("delta"))


def init_membership(points: DataFrame, k: int, seed: int = 0, id_col: str = "id"
                    ) -> DataFrame:
    """Random memberships per row, normalised to sum to 1.

    k draws keyed by the row's id (no shuffle), normalised in the same
    projection, then exploded to (id, cluster, u).
    """
    wide = points.select(id_col, F.array(*[uniform(seed, id_col, F.lit(j)) for j in range(k)]).alias("r"))
    total = F.aggregate("r", F.lit(0.0), lambda acc, x: acc + x)
    norm = wide.select(id_col, F.transform("r", lambda x: x / total).alias("u"))
    return explode_clusters(norm, [id_col], k)


def step_from_membership(points: DataFrame, membership_df: DataFrame, m: float,
                         id_col: str = "id", features: str = P.FEATURES) -> DataFrame:
    """Centres from a given membership table (used after B9)."""
    j = membership_df.join(points.select(id_col, features), id_col)
    d = len(points.select(features).first()[0])
    um = F.pow("u", F.lit(m))
    agg = j.groupBy("cluster").agg(
        F.sum(um).alias("weight"),
        *[F.sum(um * F.col(features)[i]).alias(f"s{i}") for i in range(d)])
    return agg.select("cluster", "weight", F.array(
        *[F.col(f"s{i}") / F.col("weight") for i in range(d)]).alias("center"))
