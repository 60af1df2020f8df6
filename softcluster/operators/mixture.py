"""Gaussian mixture by EM.

E-step: one Arrow-kernel pass emits, per partition, k x (1 + d + d*d) sums
(sum p, sum p x, sum p x x^T) plus the log-likelihood; one small aggregate
totals them.  M-step runs on those k small blocks on the driver; when the
blocks are wide ((k-1)/k * d > 25) it runs as a Spark job, one group per
component (``applyInPandas``), like the reference spreads it over the
cluster.  Densities use the pseudo-inverse of each covariance from its
eigen-decomposition, so a singular covariance still has a density.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.centers import MAX_STATE_VALUES
from ..functions.draws import sample_rows
from ..functions.kernels import batch_matrix, partial_sums
from ..sources import points as P

EPSILON = 2.220446049250313e-16
DEFAULTS = dict(k=2, max_iter=100, tol=0.01, n_samples=5)

COMPONENT_SCHEMA = T.StructType([
    T.StructField("component", T.IntegerType(), False),
    T.StructField("weight", T.DoubleType(), False),
    T.StructField("mu", T.ArrayType(T.DoubleType(), False), False),
    T.StructField("sigma", T.ArrayType(T.ArrayType(T.DoubleType(), False), False), False),
])


@dataclass
class Mixture:
    weights: np.ndarray          # (k,)
    mus: np.ndarray              # (k, d)
    sigmas: np.ndarray           # (k, d, d)
    trace: list = field(default_factory=list)

    @property
    def k(self) -> int:
        return len(self.weights)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(j, float(self.weights[j]), [float(v) for v in self.mus[j]],
                 [[float(v) for v in r] for r in self.sigmas[j]]) for j in range(self.k)]
        return spark.createDataFrame(rows, COMPONENT_SCHEMA)

    @staticmethod
    def from_df(df: DataFrame) -> "Mixture":
        values = df.agg(F.sum(F.size("mu") * (F.size("mu") + 1))).first()[0] or 0
        if values > MAX_STATE_VALUES:
            raise ValueError("components table too large to hold as model state")
        rows = df.orderBy("component").collect()
        if [r["component"] for r in rows] != list(range(len(rows))):
            raise ValueError("component ids must be 0..k-1")
        mus = np.array([r["mu"] for r in rows], dtype=np.float64)
        sig = np.array([r["sigma"] for r in rows], dtype=np.float64)
        d = mus.shape[1]
        if sig.shape != (len(rows), d, d):
            raise ValueError("sigma must be d x d for every component")
        return Mixture(np.array([r["weight"] for r in rows], dtype=np.float64), mus, sig)

    def predict_soft(self, points: DataFrame, features: str = P.FEATURES, keep=None
                     ) -> DataFrame:
        return predict_soft(points, self, features, keep)

    def predict(self, points: DataFrame, features: str = P.FEATURES, keep=None) -> DataFrame:
        return predict(points, self, features, keep)


def gaussian_constants(mu: np.ndarray, sigma: np.ndarray):
    """(root of the pseudo-inverse, log normaliser) of one component."""
    d = len(mu)
    w, v = np.linalg.eigh(sigma)
    tol = EPSILON * max(float(w.max()), 0.0) * d
    pos = w > tol
    log_pdet = float(np.sum(np.log(w[pos])))
    inv_sqrt = np.where(pos, 1.0 / np.sqrt(np.where(pos, w, 1.0)), 0.0)
    root = inv_sqrt[:, None] * v.T
    return root, -0.5 * (d * math.log(2.0 * math.pi) + log_pdet)


def constants(mix: Mixture) -> list:
    """gaussian_constants of all components: once per pass, on the driver."""
    return [gaussian_constants(mix.mus[j], mix.sigmas[j]) for j in range(mix.k)]


def responsibilities(x: np.ndarray, mix: Mixture, consts: list | None = None):
    """p_ij = EPS + w_j pdf_j(x_i), normalised per row; also log(sum p)."""
    consts = constants(mix) if consts is None else consts
    p = np.empty((x.shape[0], mix.k))
    for j, (root, u) in enumerate(consts):
        z = (x - mix.mus[j]) @ root.T
        p[:, j] = EPSILON + mix.weights[j] * np.exp(u - 0.5 * np.sum(z * z, axis=1))
    s = p.sum(axis=1)
    return p / s[:, None], np.log(s)


def estep_sums(points: DataFrame, mix: Mixture, features: str = P.FEATURES) -> np.ndarray:
    """E-step partial sums, (k + 1, 1 + d + d*d); row k slot 0 = llh."""
    k, d = mix.k, mix.mus.shape[1]
    width = 1 + d + d * d
    consts = constants(mix)

    def batch(b):
        x = batch_matrix(b, features, d)
        p, logs = responsibilities(x, mix, consts)
        out = np.zeros((k + 1, width))
        out[:k, 0] = p.sum(axis=0)
        out[:k, 1:1 + d] = p.T @ x
        for j in range(k):
            out[j, 1 + d:] = ((x * p[:, j:j + 1]).T @ x).reshape(-1)
        out[k, 0] = logs.sum()
        return out

    return partial_sums(points.select(features), (k + 1, width), batch)


def mstep(sums: np.ndarray, k: int, d: int) -> Mixture:
    """mu = sx / s; sigma = sxx / s - mu mu^T; weight = s / sum(s)."""
    s = sums[:k, 0]
    mus = sums[:k, 1:1 + d] / s[:, None]
    sxx = sums[:k, 1 + d:].reshape(k, d, d)
    sig = sxx / s[:, None, None] - np.einsum("ki,kj->kij", mus, mus)
    return Mixture(s / s.sum(), mus, sig)


def should_distribute(k: int, d: int) -> bool:
    return ((k - 1.0) / k) * d > 25


def mstep_distributed(spark: SparkSession, sums: np.ndarray, k: int, d: int) -> Mixture:
    """M-step as a Spark job, one group per component (wide d)."""
    import pandas as pd

    total = float(sums[:k, 0].sum())
    rows = [(j, float(sums[j, 0]), [float(v) for v in sums[j, 1:1 + d]],
             [float(v) for v in sums[j, 1 + d:]]) for j in range(k)]
    df = spark.createDataFrame(rows, "component int, s double, sx array<double>, sxx array<double>")

    def update(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        mu = np.asarray(r["sx"]) / r["s"]
        sig = np.asarray(r["sxx"]).reshape(d, d) / r["s"] - np.outer(mu, mu)
        return pd.DataFrame({"component": [int(r["component"])], "weight": [r["s"] / total],
                             "mu": [mu.tolist()], "sigma": [sig.reshape(-1).tolist()]})

    out = df.groupBy("component").applyInPandas(
        update, "component int, weight double, mu array<double>, sigma array<double>"
    ).orderBy("component").collect()
    return Mixture(np.array([r["weight"] for r in out]), np.array([r["mu"] for r in out]),
                   np.array([np.reshape(r["sigma"], (d, d)) for r in out]))


def em_step(points: DataFrame, mix: Mixture, features: str = P.FEATURES):
    """One EM step -> (new mixture, llh under ``mix``)."""
    k, d = mix.k, mix.mus.shape[1]
    sums = estep_sums(points, mix, features)
    new = (mstep_distributed(points.sparkSession, sums, k, d) if should_distribute(k, d)
           else mstep(sums, k, d))
    return new, float(sums[k, 0])


def init_from_sample(sample: DataFrame, k: int, features: str = P.FEATURES,
                     slice_col: str = "slice") -> Mixture:
    """E2 from a drawn sample with slice numbers 0..k-1: per slice mean and
    diagonal biased variance; weights 1/k."""
    d = len(sample.select(features).first()[0])
    agg = sample.groupBy(slice_col).agg(
        *[F.avg(F.col(features)[i]).alias(f"m{i}") for i in range(d)],
        *[F.var_pop(F.col(features)[i]).alias(f"v{i}") for i in range(d)]).orderBy(
        slice_col).collect()
    if len(agg) != k:
        raise ValueError(f"sample holds {len(agg)} slices, expected {k}")
    mus = np.array([[r[f"m{i}"] for i in range(d)] for r in agg])
    sig = np.array([np.diag([r[f"v{i}"] for i in range(d)]) for r in agg])
    return Mixture(np.full(k, 1.0 / k), mus, sig)


def draw_sample(points: DataFrame, k: int, n_samples: int = DEFAULTS["n_samples"],
                seed: int = 0, features: str = P.FEATURES) -> DataFrame:
    """E2 draw: k * n_samples rows without replacement, cut into k slices of
    n_samples.  Rows are distinct positions (like the decision for Q4)."""
    sample = sample_rows(points, [features], k * n_samples, seed)
    return sample.select(features, F.floor(F.col("place") / n_samples).cast("int").alias("slice"))


def train(points: DataFrame, k: int = DEFAULTS["k"], max_iter: int = DEFAULTS["max_iter"],
          tol: float = DEFAULTS["tol"], init=None, seed: int = 0,
          features: str = P.FEATURES) -> Mixture:
    """E1/E4.  ``init``: None (E2 sample start), a ``Mixture`` or a
    components DataFrame (warm start; never modified, quirk Q14)."""
    data, stats = P.prepare(points.select(features), features)
    try:
        if init is None:
            mix = init_from_sample(draw_sample(data, k, seed=seed, features=features), k,
                                   features)
        elif isinstance(init, DataFrame):
            mix = Mixture.from_df(init)
        else:
            mix = Mixture(init.weights.copy(), init.mus.copy(), init.sigmas.copy())
        if mix.k != k:
            raise ValueError(f"initial mixture has {mix.k} components, k = {k}")
        llh, llhp, it, trace = -np.finfo(float).max, 0.0, 0, []
        while it < max_iter and abs(llh - llhp) > tol:
            t0 = time.time()
            mix, cur = em_step(data, mix, features)
            llhp, llh = llh, cur
            it += 1
            trace.append(dict(iteration=it, llh=cur, seconds=time.time() - t0))
        mix.trace = trace
        return mix
    finally:
        data.unpersist()


def _soft(points, mix, features, keep):
    import pyarrow as pa

    keep = list(keep) if keep is not None else [c for c in points.columns if c != features]
    d = mix.mus.shape[1]
    src = P.clean(points.select(*keep, features), features)
    fields = [f for f in src.schema.fields if f.name in keep]
    out_fields = fields + [T.StructField("probability", T.ArrayType(T.DoubleType())),
                           T.StructField("prediction", T.IntegerType())]

    consts = constants(mix)

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            x = batch_matrix(b, features, d)
            p, _ = responsibilities(x, mix, consts)
            offsets = pa.array(np.arange(0, p.size + 1, mix.k, dtype=np.int32))
            prob = pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))
            cols = [b.column(b.schema.get_field_index(c)) for c in keep]
            cols += [prob, pa.array(np.argmax(p, axis=1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in out_fields])

    return src.mapInArrow(run, T.StructType(out_fields))


def predict_soft(points: DataFrame, mix: Mixture, features: str = P.FEATURES, keep=None
                 ) -> DataFrame:
    """E5: k probabilities per row."""
    return _soft(points, mix, features, keep).drop("prediction")


def predict(points: DataFrame, mix: Mixture, features: str = P.FEATURES, keep=None
            ) -> DataFrame:
    """First largest probability."""
    return _soft(points, mix, features, keep).drop("probability")


def log_likelihood(points: DataFrame, mix: Mixture, features: str = P.FEATURES) -> float:
    """E7 for one mixture: sum over rows of log(sum_j EPS + w_j pdf_j)."""
    return float(estep_sums(points, mix, features)[mix.k, 0])


def trace_df(spark: SparkSession, mix: Mixture) -> DataFrame:
    return spark.createDataFrame(
        [(int(t["iteration"]), float(t["llh"]), float(t["seconds"])) for t in mix.trace],
        "iteration int, llh double, seconds double")
