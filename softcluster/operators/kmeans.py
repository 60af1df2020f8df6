"""K-means (C1-C12): Lloyd passes, several runs at once, k-means|| seeding.

A pass is one Spark job: an Arrow kernel assigns each row to its nearest
centre for every live run and emits per-partition (sum x, count, cost) per
(run, cluster); one tiny aggregate totals them.  Cost is an aggregated
column, never an accumulator, so task retries cannot count twice.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import centers as C
from ..functions.draws import sample_rows
from ..functions.kernels import batch_matrix, batch_vector, partial_sums, sqdist, sums_by_key
from ..functions.scoring import least_distances, nearest
from ..session import cut_lineage
from ..sources import points as P

log = logging.getLogger(__name__)

DEFAULTS = dict(k=2, max_iter=20, runs=1, init="k-means||", init_steps=5, epsilon=1e-4)
INIT_MODES = ("random", "k-means||")
#: Draws of k-means++ between written cost columns.
CUT = 16
#: Candidates of a run beyond which they are reduced in groups, of at most this many rows each.
ONE_GROUP, GROUP_ROWS = 4096, 1024


def _weights(b, weight):
    return batch_vector(b, weight) if weight else None


def step_sums(points: DataFrame, centers: np.ndarray, features: str = P.FEATURES,
              weight: str | None = None, run_col: str | None = None) -> np.ndarray:
    """C9 kernel for r runs at once.

    ``centers`` is (r, k, d) or (k, d).  Returns (r*k, d + 2):
    [sum w x | sum w | sum w dist2] per (run, cluster), key = run*k + cluster.
    Every row counts in every run, unless ``run_col`` names the run a row
    belongs to (candidate tables of several runs).  Centres padded with inf
    never attract a row.
    """
    cs = centers if centers.ndim == 3 else centers[None]
    r, k, d = cs.shape
    cols = [features] + ([weight] if weight else []) + ([run_col] if run_col else [])

    def batch(b):
        x = batch_matrix(b, features, d)
        w = _weights(b, weight)
        ww = np.ones(x.shape[0]) if w is None else w
        rid = (np.asarray(b.column(b.schema.get_field_index(run_col)).to_numpy(
            zero_copy_only=False), dtype=np.int64) if run_col else None)
        out = np.zeros((r * k, d + 2))
        for run in range(r):
            rows = np.arange(x.shape[0]) if rid is None else np.nonzero(rid == run)[0]
            if rows.size == 0:
                continue
            with np.errstate(invalid="ignore"):
                dist = sqdist(x[rows], cs[run])
            a = np.argmin(dist, axis=1)  # first minimum: lowest index on ties
            cost = dist[np.arange(rows.size), a]
            keys = run * k + a
            wr = ww[rows]
            out[:, :d] += sums_by_key(keys, x[rows] * wr[:, None], r * k)
            out[:, d] += np.bincount(keys, weights=wr, minlength=r * k)
            out[:, d + 1] += np.bincount(keys, weights=cost * wr, minlength=r * k)
        return out

    return partial_sums(points.select(*cols), (r * k, d + 2), batch)


def update(centers: np.ndarray, sums: np.ndarray, epsilon: float):
    """C9 update for one run: empty clusters keep their centre.

    Returns (new, moved flag, cost under the old centres, counts).
    """
    k, d = centers.shape
    cnt = sums[:, d]
    new = centers.copy()
    live = cnt > 0
    new[live] = sums[live, :d] / cnt[live, None]
    shift2 = np.sum((new - centers) ** 2, axis=1)
    return new, bool(np.any(shift2 > epsilon * epsilon)), float(sums[:, d + 1].sum()), cnt


@dataclass
class KMeansModel:
    centers: np.ndarray
    cost: float = float("nan")
    trace: list = field(default_factory=list)
    run: int = 0

    @property
    def k(self) -> int:
        return self.centers.shape[0]

    def centers_df(self, spark: SparkSession) -> DataFrame:
        return C.to_df(spark, self.centers)

    def predict(self, points: DataFrame, features: str = P.FEATURES,
                out: str = "prediction") -> DataFrame:
        return predict(points, self.centers, features, out)

    def compute_cost(self, points: DataFrame, features: str = P.FEATURES) -> float:
        return compute_cost(points, self.centers, features)


def train(points: DataFrame, k: int = DEFAULTS["k"], max_iter: int = DEFAULTS["max_iter"],
          runs: int = DEFAULTS["runs"], init=DEFAULTS["init"],
          init_steps: int = DEFAULTS["init_steps"], epsilon: float = DEFAULTS["epsilon"],
          seed: int = 0, features: str = P.FEATURES, weight: str | None = None
          ) -> KMeansModel:
    """Lloyd's algorithm.  ``init`` is "random", "k-means||", a
    numpy (k, d) / (r, k, d) array or a centres DataFrame (warm start: forces
    one run)."""
    if isinstance(init, str) and init not in INIT_MODES:
        raise ValueError(f"unknown init mode {init!r} (quirk Q8: no silent fallback)")
    if k < 1 or runs < 1:
        raise ValueError("k and runs must be >= 1")
    data, _ = P.prepare(points.select(*([features] + ([weight] if weight else []))),
                        features)
    try:
        starts = _initial(data, k, runs, init, init_steps, seed, features, weight)
        return lloyd(data, starts, max_iter, epsilon, features, weight)
    finally:
        data.unpersist()


def _initial(data, k, runs, init, init_steps, seed, features, weight):
    if isinstance(init, DataFrame):
        return C.from_df(init, k)[None]
    if isinstance(init, np.ndarray):
        arr = np.asarray(init, dtype=np.float64)
        arr = arr if arr.ndim == 3 else arr[None]
        if arr.shape[1] != k:
            raise ValueError("initial centres must have k rows (C10)")
        return arr
    if init == "random":
        return init_random(data, k, runs, seed, features)
    return init_parallel_runs(data, k, runs, init_steps, seed, features, weight)


def lloyd(data: DataFrame, starts: np.ndarray, max_iter: int, epsilon: float,
          features: str = P.FEATURES, weight: str | None = None) -> KMeansModel:
    """All runs advance in one pass; a finished run drops out.

    Best run = lowest cost measured in its last pass, i.e. under the centres
    before the last move (quirk Q9, kept on purpose).
    """
    cs = np.array(starts, dtype=np.float64)
    r, k, d = cs.shape
    active = list(range(r))
    costs = np.full(r, np.inf)
    trace = []
    for it in range(1, max_iter + 1):
        if not active:
            break
        t0 = time.time()
        sums = step_sums(data, cs[active], features, weight).reshape(len(active), k, d + 2)
        still = []
        moved_max = 0.0
        for pos, run in enumerate(active):
            new, moved, cost, _ = update(cs[run], sums[pos], epsilon)
            moved_max = max(moved_max, float(np.sqrt(np.max(np.sum((new - cs[run]) ** 2, 1)))))
            cs[run], costs[run] = new, cost
            if moved:
                still.append(run)
        trace.append(dict(iteration=it, value=float(np.min(costs[active])),
                          max_shift=moved_max, seconds=time.time() - t0))
        active = still
    best = int(np.argmin(costs))
    return KMeansModel(centers=cs[best], cost=float(costs[best]), trace=trace, run=best)


# --- seeding ---------------------------------------------------------------

def init_random(points: DataFrame, k: int, runs: int = 1, seed: int = 0,
                features: str = P.FEATURES, key=None) -> np.ndarray:
    """runs*k rows, drawn without replacement by a hash of the row (or of a
    column ``key`` that tells rows apart) and the seed."""
    rows = sample_rows(points, [features], runs * k, seed, key).orderBy("place").collect()
    if len(rows) < runs * k:
        raise ValueError(f"need {runs * k} rows, table has {len(rows)}")
    return np.array([r[0] for r in rows], dtype=np.float64).reshape(runs, k, -1)


def cost_column(points: DataFrame, centers: np.ndarray, features: str = P.FEATURES,
                prev: str | None = None, out: str = "cost") -> DataFrame:
    """C5 cost: min squared distance to ``centers``, as a running minimum
    with an existing cost column ``prev`` (only new centres are compared)."""
    keep = [c for c in points.columns if c != out]
    old = points if prev is None else points.withColumn("_prev", F.array(prev))
    least = least_distances(old, features, [np.asarray(centers)], keep, None if prev is None else "_prev", "_new")
    return least.select(*[c for c in keep if c != features], features, F.col("_new")[0].alias(out))


def oversample(points_with_cost: DataFrame, k: int, seed: int,
               features: str = P.FEATURES, cost: str = "cost") -> np.ndarray:
    """C5 draw: keep a row with probability 2k*cost/sum(cost).

    The kept rows are candidates: 2k per round in expectation, a model-sized
    set, which is what reaches the driver.
    """
    total = points_with_cost.agg(F.sum(cost)).first()[0] or 0.0
    if total <= 0:
        return np.zeros((0, 0))
    rows = points_with_cost.where(
        F.rand(seed) < F.lit(2.0 * k) * F.col(cost) / F.lit(total)).select(features).collect()
    return np.array([r[0] for r in rows], dtype=np.float64)


def candidate_weights(points: DataFrame, candidates: np.ndarray,
                      features: str = P.FEATURES, weight: str | None = None) -> np.ndarray:
    """Number (or weight) of rows nearest each candidate."""
    d = candidates.shape[1]
    return step_sums(points, candidates, features, weight)[:, d]


def init_parallel(points: DataFrame, k: int, init_steps: int = 5, seed: int = 0,
                  features: str = P.FEATURES, weight: str | None = None) -> np.ndarray:
    """C4 for one run: (k, d) start centres."""
    return init_parallel_runs(points, k, 1, init_steps, seed, features, weight)[0]


def _run_costs(points: DataFrame, news: list, features: str, prev: str | None) -> DataFrame:
    """Cost array column: per run, min over that run's new centres (and the
    previous cost).  One projection for all runs."""
    keep = [c for c in points.columns if c != "cost"]
    d = len(next(c for cs in news for c in cs))
    return least_distances(points, features, [np.array(cs).reshape(len(cs), d) for cs in news], keep, prev, "cost")


def init_parallel_runs(points: DataFrame, k: int, runs: int = 1, init_steps: int = 5,
                       seed: int = 0, features: str = P.FEATURES,
                       weight: str | None = None) -> np.ndarray:
    """C4: k-means|| for all runs in shared passes over the data.

    Per round: one aggregate for the r cost totals, one scan keeping a row for
    run r with probability 2k*cost_r/total_r (independent draws per run), one
    projection updating the r running minima.  Candidates (2k per round and
    run in expectation) are weighed in one kernel pass (C6) and reduced to k
    per run by weighted k-means++ and Lloyd over the run-keyed candidate
    table (C7)."""
    spark = points.sparkSession
    first = points.select(features).orderBy(F.rand(seed)).limit(runs).collect()
    if len(first) < runs:
        raise ValueError("fewer rows than runs")
    cands = [[np.array(first[r][0], dtype=np.float64)] for r in range(runs)]
    cur = _run_costs(points.select(features), [[c[0]] for c in cands], features, None
                     ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for step in range(init_steps):
            tot = cur.agg(*[F.sum(F.col("cost")[r]).alias(f"t{r}") for r in range(runs)]).first()
            picks = [F.rand(seed * 7919 + 104729 * (step + 1) + r) * F.lit(float(tot[f"t{r}"] or 0.0))
                     < F.lit(2.0 * k) * F.col("cost")[r] for r in range(runs)]
            rows = cur.select(features, F.array(*picks).alias("_sel")).where(
                F.exists("_sel", lambda v: v)).collect()
            news = [[np.array(rw[0], dtype=np.float64) for rw in rows if rw[1][r]]
                    for r in range(runs)]
            if not any(news):
                break
            for r in range(runs):
                cands[r].extend(news[r])
            nxt = _run_costs(cur, news, features, "cost").persist(StorageLevel.MEMORY_AND_DISK)
            nxt.count()
            cur.unpersist()
            cur = nxt
    finally:
        cur.unpersist()
    uniq = [np.unique(np.array(c), axis=0) for c in cands]
    d = uniq[0].shape[1]
    cmax = max(len(u) for u in uniq)
    padded = np.full((runs, cmax, d), np.inf)
    for r, u in enumerate(uniq):
        padded[r, :len(u)] = u
    w = step_sums(points, padded, features, weight)[:, d].reshape(runs, cmax)
    out = _reduce_runs(spark, uniq, list(w[r, :len(u)] for r, u in enumerate(uniq)), k, 30, seed)
    for r, cs in enumerate(out):
        if len(cs) < k:
            log.warning("k-means||: only %d distinct candidates for k=%d (Q10)", len(cs), k)
    if runs == 1:
        return np.array([out[0]])
    # every run needs k rows: a short run repeats its first centre (the
    # duplicate attracts no rows and restarts in Lloyd's empty-cluster rule)
    return np.stack([np.vstack([c] + [c[:1]] * (k - len(c))) if len(c) < k else c
                     for c in out])


def _reduce_candidates(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator,
                       max_iter: int) -> np.ndarray:
    """Weighted k-means++ then weighted Lloyd on one run's candidates (numpy
    inside one task; the candidate set is model-sized).  The k-means++ draw
    is an exponential race: argmin of -ln(U)/(w*cost) picks row i with
    probability w_i c_i / sum.  An empty cluster restarts at a random row."""
    live = w > 0
    x, w = x[live], w[live]
    if len(x) == 0:
        return np.zeros((0, 0))
    centers = [x[np.argmin(-np.log(rng.random(len(x))) / w)]]
    cost = np.sum((x - centers[0]) ** 2, axis=1)
    while len(centers) < k:
        ok = cost > 0
        if not ok.any():
            break  # Q10: fewer distinct candidates than k
        race = np.full(len(x), np.inf)
        race[ok] = -np.log(rng.random(int(ok.sum()))) / (w[ok] * cost[ok])
        c = x[np.argmin(race)]
        centers.append(c)
        cost = np.minimum(cost, np.sum((x - c) ** 2, axis=1))
    cs = np.array(centers)
    for _ in range(max_iter):
        a = np.argmin(sqdist(x, cs), axis=1)
        new = cs.copy()
        for j in range(len(cs)):
            m = a == j
            if m.any():
                new[j] = (w[m, None] * x[m]).sum(axis=0) / w[m].sum()
            else:
                new[j] = x[rng.integers(len(x))]
        moved = bool(np.any(new != cs))
        cs = new
        if not moved:
            break
    return cs


def _compact_groups(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of groups of at most ``size`` rows that lie close together:
    halved at the median of the widest coordinate until they fit."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        wide = int(np.argmax(x[rows].max(axis=0) - x[rows].min(axis=0)))
        rows = rows[np.argsort(x[rows, wide], kind="stable")]
        todo += [rows[:len(rows) // 2], rows[len(rows) // 2:]]
    return out


def _shares(x: np.ndarray, w: np.ndarray, groups: list[np.ndarray], k: int) -> list[int]:
    """How many of k centres each group gets: one, and the rest by the root of
    its weight times its cost around its mean; no more than its distinct rows."""
    most = np.array([len(np.unique(x[g], axis=0)) for g in groups])
    need = np.empty(len(groups))
    for i, g in enumerate(groups):
        mean = np.average(x[g], axis=0, weights=w[g])
        need[i] = np.sqrt(w[g].sum() * (w[g] @ np.sum((x[g] - mean) ** 2, axis=1)))
    got = np.minimum(1, most)
    while (left := min(k, most.sum()) - got.sum()) > 0:
        open_ = got < most
        part = np.where(open_, need + 1e-300, 0.0)
        more = np.minimum(np.floor(left * part / part.sum()).astype(int), most - got)
        if not more.any():
            first = np.argsort(-part / (got + 1.0), kind="stable")[:left]
            more[first[open_[first]]] = 1
        got = got + more
    return got.tolist()


def _reduce_runs(spark: SparkSession, cands: list, weights: list, k: int, max_iter: int, seed: int,
                 one_group: int | None = None, polish: int = 3) -> list:
    """C7 for all runs: each run's weighted candidates to (<= k, d) centres.

    A run of few candidates is one group.  More of them are parted into compact
    groups, every group is reduced to its share of the centres, and a few
    weighted passes over all candidates move the union.  Candidates are model
    state (2k a round and run), the groups are tasks of one job.
    """
    import pandas as pd

    one_group = ONE_GROUP if one_group is None else one_group
    d = cands[0].shape[1]
    rows, parted = [], []
    for run, (x, w) in enumerate(zip(cands, weights)):
        live = w > 0
        x, w = x[live], w[live]
        # At most k groups: each one gives a centre at least.
        size = len(x) if len(x) <= one_group else max(GROUP_ROWS * one_group // ONE_GROUP, -(-2 * len(x) // k))
        groups = _compact_groups(x, max(1, size))
        share = [k] if len(groups) == 1 else _shares(x, w, groups, k)
        parted.append(len(groups) > 1)
        rows += [(run, g, share[g], x[i].tolist(), float(w[i])) for g, at in enumerate(groups) for i in at.tolist()]
    table = spark.createDataFrame(rows, "run int, grp int, k int, features array<double>, weight double")

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        run, grp, share = (int(pdf[c].iloc[0]) for c in ("run", "grp", "k"))
        x = np.array(pdf["features"].tolist(), dtype=np.float64)
        rng = np.random.default_rng([seed, run] if grp == 0 else [seed, run, grp])
        cs = _reduce_candidates(x, pdf["weight"].to_numpy(dtype=np.float64), share, rng, max_iter)
        return pd.DataFrame({"run": run, "grp": grp, "place": range(len(cs)), "center": [c.tolist() for c in cs]})

    found = table.groupBy("run", "grp").applyInPandas(per_group, "run int, grp int, place int, center array<double>").collect()
    out = [np.array([r["center"] for r in sorted(found, key=lambda r: (r["grp"], r["place"])) if r["run"] == run]).reshape(-1, d)
           for run in range(len(cands))]
    for run in np.flatnonzero(parted).tolist():
        own = table.where(F.col("run") == run).select("features", "weight").persist(StorageLevel.MEMORY_AND_DISK)
        for _ in range(polish):
            out[run] = update(out[run], step_sums(own, out[run], "features", "weight"), 0.0)[0]
        own.unpersist()
    return out


def _uniform(features: str, seed: int):
    """step -> a uniform draw in (0, 1] of every row, by a hash of its point."""
    def draw(step: int):
        return (F.pmod(F.xxhash64(features, F.lit(seed), F.lit(step)), F.lit(1 << 52)) + 1) / float(1 << 52)
    return draw


def kmeans_pp(table: DataFrame, k: int, seed: int = 0, features: str = P.FEATURES,
              weight: str = "weight", draws=None) -> np.ndarray:
    """C7 seeding of a weighted table of any size: (<= k, d) centres (Q10).

    An exponential race: the row of the least -ln(u) / (weight * cost) is
    drawn with probability weight * cost / sum, so a step is a top-1 over the
    rows and a map that lowers their cost.  ``draws``: step -> column of u.
    """
    draws = draws or _uniform(features, seed)
    centers: list[np.ndarray] = []
    rows, held = table.where(F.col(weight) > 0).withColumn("cost", F.lit(1.0)), None
    try:
        for step in range(k):
            race = -F.log(draws(step)) / (F.col(weight) * F.col("cost"))
            first = rows.where("cost > 0").select(features, race.alias("race")).orderBy("race", features).limit(1).collect()
            if held is not None and held is not rows:
                held.unpersist()
            held = rows
            if not first:
                break  # Q10: fewer distinct candidates than k
            centers.append(np.array(first[0][0], dtype=np.float64))
            if step + 1 < k:
                # The running minimum: a row meets each centre once.
                rows = cost_column(rows, centers[-1][None], features, "cost" if step else None)
                rows = rows.persist(StorageLevel.MEMORY_AND_DISK) if (step + 1) % CUT else cut_lineage(rows)
    finally:
        for df in (held, rows):
            if df is not None:
                df.unpersist()
    return np.array(centers)


def weighted_kmeans(table: DataFrame, k: int, max_iter: int = 30, seed: int = 0,
                    features: str = P.FEATURES, weight: str = "weight", draws=None) -> np.ndarray:
    """C7 for a weighted table of any size: weighted k-means++, then weighted
    Lloyd passes; an empty cluster restarts at a drawn row."""
    draws = draws or _uniform(features, seed)
    cs = kmeans_pp(table, k, seed, features, weight, draws)
    for it in range(max_iter if len(cs) else 0):
        new, _, _, count = update(cs, step_sums(table.where(F.col(weight) > 0), cs, features, weight), 0.0)
        empty = np.flatnonzero(count <= 0)
        if len(empty):
            drawn = table.select(features).orderBy(draws(k + it), features).limit(len(empty)).collect()
            new[empty[:len(drawn)]] = [r[0] for r in drawn]
        done = np.array_equal(new, cs)
        cs = new
        if done:
            break
    return cs


def weighted_step(table: DataFrame, centers: np.ndarray, features: str = P.FEATURES,
                  weight: str = "weight") -> DataFrame:
    """C7 step as a table: (cluster, weight, center) after one weighted pass."""
    sums = step_sums(table, centers, features, weight)
    d = centers.shape[1]
    new, _, _, w = update(centers, sums, 0.0)
    return C.to_df(table.sparkSession, new, weight=w)


# --- scoring ---------------------------------------------------------------

def assign(points: DataFrame, centers: np.ndarray, features: str = P.FEATURES,
           keep=None) -> DataFrame:
    """Nearest centre and its squared distance."""
    keep = list(keep) if keep is not None else [c for c in points.columns if c != features]
    return nearest(points, features, centers, [*keep, features])


def step_table(points: DataFrame, centers: np.ndarray, features: str = P.FEATURES
               ) -> DataFrame:
    """C9 readable twin: groupBy(cluster) over C8, left join to old centres
    (an empty cluster keeps its centre).  The centre side is k rows."""
    spark = points.sparkSession
    d = centers.shape[1]
    a = assign(points, centers, features, keep=[])
    agg = a.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("count"), F.sum("dist2").alias("cost"),
        *[F.avg(F.col(features)[i]).alias(f"m{i}") for i in range(d)])
    old = C.to_df(spark, centers)
    j = F.broadcast(old).join(agg, "cluster", "left")
    return j.select(
        "cluster", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        F.coalesce("cost", F.lit(0.0)).alias("cost"),
        F.when(F.col("count").isNull(), F.col("center")).otherwise(
            F.array(*[F.col(f"m{i}") for i in range(d)])).alias("center"))


def predict(points: DataFrame, centers: np.ndarray, features: str = P.FEATURES,
            out: str = "prediction") -> DataFrame:
    """C11."""
    keep = [c for c in points.columns if c != features]
    return assign(points, centers, features, keep).drop("dist2").withColumnRenamed(
        "cluster", out)


def compute_cost(points: DataFrame, centers: np.ndarray, features: str = P.FEATURES
                 ) -> float:
    """Sum of squared distances to the nearest centre."""
    return float(assign(points, centers, features, keep=[]).agg(F.sum("dist2")).first()[0])
