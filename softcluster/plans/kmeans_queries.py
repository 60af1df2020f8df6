"""Registered k-means queries (section C) and their oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import centers as C
from ..functions import draws
from ..operators import kmeans, kmeans_pruned
from ..sources import points as P
from . import fixtures as X
from . import sqlgen as S
from .fuzzy_queries import GROUP_SQL, LI_KEEP, VALUE_KEY_SQL, drawn_sql, ev_start, li_start, value_key
from .registry import query

K, D, STEPS = 4, 4, 5
ALT_GROUP_SQL = "floor(x1 / 27.0)"


def li_alt_start(spark, sf_dir):
    pts = X.points_li(spark, sf_dir)
    return C.from_df(C.group_means(pts, F.floor(F.col(P.FEATURES)[1] / 27.0), dim=D))


def _li():
    return [S.li_points("p"), S.group_mean_centers("c0", "p", GROUP_SQL, K, D)]


def _ev():
    return [S.ev_points("p"), S.group_mean_centers("c0", "p", "floor(x1 * 4.0)", K, 2)]


def _long(cname, k, d):
    return S.centers_long(cname, k, d)


# C1 ---------------------------------------------------------------------------

def _train_sql():
    chain, last = S.kmeans_chain("k", "p", "c0", K, D, STEPS, 0.0)
    return S.with_(_li() + chain, _long(last, K, D))


@query("kmeans_train", _train_sql)
def kmeans_train(spark, sf_dir):
    """5 Lloyd passes from group-mean centres (stop rule at eps = 0)."""
    pts, start = li_start(spark, sf_dir)
    model = kmeans.train(pts, k=K, max_iter=STEPS, epsilon=0.0, init=start)
    return C.long_form(model.centers_df(spark))


# C2 ---------------------------------------------------------------------------

def _best_run_sql():
    ctes = _li() + [S.group_mean_centers("b0", "p", ALT_GROUP_SQL, K, D)]
    ch0, last0 = S.kmeans_chain("r0_", "p", "c0", K, D, STEPS, 1e-4)
    ch1, last1 = S.kmeans_chain("r1_", "p", "b0", K, D, STEPS, 1e-4)
    cols = ", ".join(S.ccol(j, i) for j in range(K) for i in range(D))
    best = S.cte("best", f"SELECT * FROM (SELECT 0 AS run, cost, {cols} FROM {last0} "
                         f"UNION ALL SELECT 1 AS run, cost, {cols} FROM {last1}) "
                         f"ORDER BY cost, run LIMIT 1")
    body = "\nUNION ALL\n".join(
        f"SELECT CAST(run AS INTEGER) AS run, CAST(round(cost, 4) AS DOUBLE) AS cost, "
        f"CAST({j} AS INTEGER) AS cluster, CAST({i} AS INTEGER) AS dim, "
        f"CAST(round({S.ccol(j, i)}, 6) AS DOUBLE) AS value FROM best"
        for j in range(K) for i in range(D))
    return S.with_(ctes + ch0 + ch1 + [best], body)


@query("kmeans_best_run", _best_run_sql)
def kmeans_best_run(spark, sf_dir):
    """Two runs in one pass per iteration; the cheaper run wins (Q9)."""
    pts, s0 = li_start(spark, sf_dir)
    s1 = li_alt_start(spark, sf_dir)
    model = kmeans.train(pts, k=K, max_iter=STEPS, epsilon=1e-4, init=np.stack([s0, s1]))
    long = C.long_form(model.centers_df(spark))
    return long.select(F.lit(model.run).cast("int").alias("run"),
                       F.lit(round(model.cost, 4)).cast("double").alias("cost"),
                       "cluster", "dim", "value")


# C5 / C6 ----------------------------------------------------------------------

def _cost_column_sql():
    ctes = _li()
    d_a = " , ".join(S.dist_expr(j, D) for j in (0, 1))
    d_b = " , ".join(S.dist_expr(j, D) for j in (2, 3))
    body = (f"SELECT l_orderkey, l_linenumber, CAST(round(least(least({d_a}), least({d_b})), 6) "
            f"AS DOUBLE) AS cost FROM p, c0")
    return S.with_(ctes, body)


@query("kmeans_cost_column", _cost_column_sql)
def kmeans_cost_column(spark, sf_dir):
    """Running-minimum cost; only the new centres are compared."""
    pts, start = li_start(spark, sf_dir)
    c1 = kmeans.cost_column(pts, start[:2])
    c2 = kmeans.cost_column(c1, start[2:], prev="cost")
    return c2.select(*LI_KEEP, F.round("cost", 6).alias("cost"))


def _cand_weights_sql():
    ctes = _li() + S.assign_ctes("a", "p", "c0", K, D, keep=[])
    return S.with_(ctes, "SELECT a AS cluster, count(*) AS weight FROM a GROUP BY a")


@query("kmeans_candidate_weights", _cand_weights_sql)
def kmeans_candidate_weights(spark, sf_dir):
    """Rows nearest each candidate (candidates = group means)."""
    pts, cands = li_start(spark, sf_dir)
    w = kmeans.candidate_weights(pts, cands)
    return spark.createDataFrame(
        [(j, int(v)) for j, v in enumerate(w) if v > 0], "cluster int, weight long")


# C7 ---------------------------------------------------------------------------

def weighted_points(spark, sf_dir):
    """points_li grouped by floor(quantity/5): mean features and row count."""
    pts = X.points_li(spark, sf_dir)
    g = F.floor(F.col(P.FEATURES)[0] / 5.0).cast("int")
    agg = pts.groupBy(g.alias("cluster")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"),
        *[F.avg(F.col(P.FEATURES)[i]).alias(f"m{i}") for i in range(D)])
    return agg.select("cluster", F.array(*[F.col(f"m{i}") for i in range(D)]).alias(
        P.FEATURES), "weight")


def _weighted_step_sql():
    means = ", ".join(f"avg(x{i}) AS x{i}" for i in range(D))
    ctes = _li() + [S.cte("wp", f"SELECT floor(x0 / 5.0) AS g, {means}, "
                                f"CAST(count(*) AS DOUBLE) AS w FROM p GROUP BY 1")]
    ctes += S.assign_ctes("a", "wp", "c0", K, D, keep=[], weight="w")
    rows = []
    for j in range(K):
        for i in range(D):
            rows.append(
                f"SELECT CAST({j} AS INTEGER) AS cluster, "
                f"CAST(round(sum(CASE WHEN a = {j} THEN w ELSE 0.0 END), 4) AS DOUBLE) AS weight, "
                f"CAST({i} AS INTEGER) AS dim, CAST(round(CASE WHEN sum(CASE WHEN a = {j} THEN w ELSE 0.0 END) > 0 "
                f"THEN sum(CASE WHEN a = {j} THEN w * x{i} ELSE 0.0 END) / "
                f"sum(CASE WHEN a = {j} THEN w ELSE 0.0 END) ELSE max({S.ccol(j, i)}) END, 6) AS DOUBLE) "
                f"AS value FROM a, c0")
    return S.with_(ctes, "\nUNION ALL\n".join(rows))


@query("kmeans_weighted_step", _weighted_step_sql)
def kmeans_weighted_step(spark, sf_dir):
    """One weighted Lloyd pass over the weighted-points table."""
    _, start = li_start(spark, sf_dir)
    wp = weighted_points(spark, sf_dir)
    out = kmeans.weighted_step(wp, start)
    return out.select("cluster", F.round("weight", 4).alias("weight"),
                      F.posexplode("center").alias("dim", "value")).select(
        "cluster", "weight", F.col("dim").cast("int").alias("dim"),
        F.round("value", 6).alias("value"))


PP_PASSES = 8


def _draw(step):
    """Given draws: a fixed function of the point's group and the step."""
    return f"(CAST((g * 37 + {step} * 11) % 101 AS DOUBLE) + 1.0) / 102.0"


def _weighted_kmeans_sql():
    means = ", ".join(f"avg(x{i}) AS x{i}" for i in range(D))
    xs = ", ".join(f"x{i}" for i in range(D))
    ctes = _li() + [S.cte("wp", f"SELECT CAST(floor(x0 / 5.0) AS BIGINT) AS g, {means}, "
                                f"CAST(count(*) AS DOUBLE) AS w FROM p GROUP BY 1")]
    cost = "1.0"
    for t in range(K):
        src = "wp" + "".join(f", q{j}" for j in range(t))
        if t:
            each = [" + ".join(f"(x{i} - {S.ccol(j, i)}) * (x{i} - {S.ccol(j, i)})" for i in range(D)) for j in range(t)]
            cost = f"least({', '.join(each)})" if t > 1 else each[0]
        ctes.append(S.cte(f"q{t}", "SELECT " + ", ".join(f"x{i} AS {S.ccol(t, i)}" for i in range(D)) + " FROM ("
                                   f"SELECT {xs}, -ln({_draw(t)}) / (w * ({cost})) AS race FROM {src} WHERE {cost} > 0 "
                                   f"ORDER BY race, {xs} LIMIT 1)"))
    ctes.append(S.cte("q", "SELECT * FROM " + ", ".join(f"q{t}" for t in range(K))))
    chain, last = S.kmeans_chain("pp", "wp", "q", K, D, PP_PASSES, 0.0, weight="w")
    return S.with_(ctes + chain, _long(last, K, D))


@query("kmeans_weighted", _weighted_kmeans_sql)
def kmeans_weighted(spark, sf_dir):
    """Weighted k-means++ with given draws, then weighted Lloyd passes."""
    wp = weighted_points(spark, sf_dir).withColumn("g", F.col("cluster").cast("long"))

    def draws(step):
        x = F.floor(F.col(P.FEATURES)[0] / 5.0)
        return ((x * 37 + step * 11) % 101 + 1.0) / 102.0

    cs = kmeans.weighted_kmeans(wp, K, max_iter=PP_PASSES, draws=draws)
    return C.long_form(C.to_df(spark, cs))


# C8 / C9 ------------------------------------------------------------------------

def _assign_sql():
    ctes = _li() + S.assign_ctes("a", "p", "c0", K, D, keep=LI_KEEP)
    return S.with_(ctes, "SELECT l_orderkey, l_linenumber, a AS cluster, "
                         "CAST(round(dmin, 6) AS DOUBLE) AS dist2 FROM a")


@query("kmeans_assign", _assign_sql)
def kmeans_assign(spark, sf_dir):
    pts, start = li_start(spark, sf_dir)
    out = kmeans.assign(pts, start, keep=LI_KEEP)
    return out.select(*LI_KEEP, "cluster", F.round("dist2", 6).alias("dist2"))


def _step_sql():
    ctes = _li() + S.assign_ctes("a", "p", "c0", K, D, keep=[])
    rows = []
    for j in range(K):
        for i in range(D):
            rows.append(
                f"SELECT CAST({j} AS INTEGER) AS cluster, "
                f"count(*) FILTER (WHERE a = {j}) AS count, "
                f"CAST(round(coalesce(sum(dmin) FILTER (WHERE a = {j}), 0.0), 4) AS DOUBLE) AS cost, "
                f"CAST({i} AS INTEGER) AS dim, "
                f"CAST(round(coalesce(avg(x{i}) FILTER (WHERE a = {j}), max({S.ccol(j, i)})), 6) "
                f"AS DOUBLE) AS value FROM a, c0")
    return S.with_(ctes, "\nUNION ALL\n".join(rows))


@query("kmeans_step", _step_sql)
def kmeans_step(spark, sf_dir):
    """C9 through the JVM twin (groupBy + left join to the k old centres)."""
    pts, start = li_start(spark, sf_dir)
    out = kmeans.step_table(pts, start)
    return out.select("cluster", "count", F.round("cost", 4).alias("cost"),
                      F.posexplode("center").alias("dim", "value")).select(
        "cluster", "count", "cost", F.col("dim").cast("int").alias("dim"),
        F.round("value", 6).alias("value"))


# C10 - C12 ----------------------------------------------------------------------

def _warm_sql():
    chain, last = S.kmeans_chain("k", "p", "c0", K, 2, 20, 1e-4)
    return S.with_(_ev() + chain, _long(last, K, 2))


@query("kmeans_warm_start", _warm_sql)
def kmeans_warm_start(spark, sf_dir):
    """Warm start from a centres table, default stop rule, 20 passes max."""
    pts, start = ev_start(spark, sf_dir)
    model = kmeans.train(pts, k=K, init=C.to_df(spark, start))
    return C.long_form(model.centers_df(spark))


def _predict_sql():
    ctes = _ev() + S.assign_ctes("a", "p", "c0", K, 2, keep=["event_id"])
    return S.with_(ctes, "SELECT event_id, a AS prediction FROM a")


@query("kmeans_predict", _predict_sql)
def kmeans_predict(spark, sf_dir):
    pts, start = ev_start(spark, sf_dir)
    return kmeans.predict(pts, start).select("event_id", "prediction")


def _cost_sql():
    ctes = _ev() + S.assign_ctes("a", "p", "c0", K, 2, keep=[])
    return S.with_(ctes, "SELECT CAST(round(sum(dmin), 6) AS DOUBLE) AS cost FROM a")


@query("kmeans_cost", _cost_sql)
def kmeans_cost(spark, sf_dir):
    pts, start = ev_start(spark, sf_dir)
    a = kmeans.assign(pts, start, keep=[])
    return a.agg(F.round(F.sum("dist2"), 6).alias("cost"))


# C3 (keyed draws), C4 / C5 sample (random: rows-only) ---------------------------

@query("kmeans_init_random", lambda: drawn_sql(
    "SELECT * FROM p", draws.uniform_sql(3, "l_orderkey", "l_linenumber", VALUE_KEY_SQL)))
def kmeans_init_random(spark, sf_dir):
    """Rows of the least draws, keyed by order line and values."""
    pts = X.points_li(spark, sf_dir)
    key = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), value_key())
    return C.long_form(C.to_df(spark, kmeans.init_random(pts, K, 1, seed=3, key=key)[0]))


@query("kmeans_init_parallel")
def kmeans_init_parallel(spark, sf_dir):
    pts = X.points_li(spark, sf_dir)
    return C.long_form(C.to_df(spark, kmeans.init_parallel(pts, K, 5, seed=5)))


# A1 / A6 / C5 sample --------------------------------------------------------------

def _norms_sql():
    return S.with_([S.li_points("p")],
                   "SELECT l_orderkey, l_linenumber, CAST(round(sqrt(" +
                   " + ".join(f"x{i} * x{i}" for i in range(D)) + "), 6) AS DOUBLE) AS norm FROM p")


@query("points_norms", _norms_sql)
def points_norms(spark, sf_dir):
    """A1: points table with L2 norms (JVM-side aggregate over the array)."""
    pts = P.with_norms(X.points_li(spark, sf_dir))
    return pts.select(*LI_KEEP, F.round("norm", 6).alias("norm"))


@query("kmeans_model_roundtrip", _train_sql)
def kmeans_model_roundtrip(spark, sf_dir):
    """Trained centres saved as parquet + meta, loaded with checks."""
    from ..sources import store
    pts, start = li_start(spark, sf_dir)
    model = kmeans.train(pts, k=K, max_iter=STEPS, epsilon=0.0, init=start)
    path = store.save_centers(model.centers_df(spark))
    centers, meta = store.load_centers(spark, path)
    assert meta["k"] == K
    return C.long_form(centers)


@query("kmeans_oversample")
def kmeans_oversample(spark, sf_dir):
    """C5 draw: rows kept with probability 2k * cost / sum(cost)."""
    pts, start = li_start(spark, sf_dir)
    cost = kmeans.cost_column(pts.select(P.FEATURES), start[:1])
    return C.long_form(C.to_df(spark, kmeans.oversample(cost, K, seed=21)))


# 64 dimensions, 64 centres --------------------------------------------------------

WIDE = 64


def emb_start(spark, sf_dir):
    pts = X.points_emb(spark, sf_dir).persist()
    return pts, C.from_df(C.group_means(pts, F.col("vec_id") % WIDE, dim=WIDE))


def _emb_near():
    """Every vector's nearest of the 64 group means: n(vec_id, cluster, dist2)."""
    means = ", ".join(f"avg(CAST(embedding[{i + 1}] AS DOUBLE))" for i in range(WIDE))
    return [S.cte("p", "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL "
                       "AND list_count(embedding) = len(embedding)"),
            S.cte("c", f"SELECT CAST(row_number() OVER (ORDER BY vec_id % {WIDE}) - 1 AS INTEGER) AS cluster, [{means}] AS c "
                       f"FROM embeddings WHERE embedding IS NOT NULL GROUP BY vec_id % {WIDE}"),
            S.cte("d", "SELECT vec_id, cluster, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) "
                       "AS dist2 FROM p, c"),
            S.cte("n", "SELECT vec_id, arg_min(cluster, (dist2, cluster)) AS cluster, min(dist2) AS dist2 FROM d GROUP BY vec_id")]


@query("kmeans_assign_wide", lambda: S.with_(
    _emb_near(), "SELECT vec_id, cluster, CAST(round(dist2, 6) AS DOUBLE) AS dist2 FROM n"))
def kmeans_assign_wide(spark, sf_dir):
    """C8 at k = 64, d = 64."""
    pts, start = emb_start(spark, sf_dir)
    return kmeans.assign(pts, start, keep=["vec_id"]).select("vec_id", "cluster", F.round("dist2", 6).alias("dist2"))


@query("kmeans_cost_wide", lambda: S.with_(
    _emb_near(), "SELECT CAST(round(sum(dist2), 4) AS DOUBLE) AS cost FROM n"))
def kmeans_cost_wide(spark, sf_dir):
    """C12 at k = 64, d = 64."""
    pts, start = emb_start(spark, sf_dir)
    return spark.createDataFrame([(round(kmeans.compute_cost(pts, start), 4),)], "cost double")


@query("kmeans_init_parallel_wide")
def kmeans_init_parallel_wide(spark, sf_dir):
    """C4 at k = 64, d = 64 (rows-only)."""
    pts = X.points_emb(spark, sf_dir).persist()
    return C.long_form(C.to_df(spark, kmeans.init_parallel(pts, WIDE, 5, seed=5)))


# Pruned passes (C8, C9, C11) --------------------------------------------------------

PRUNED_STEPS = 4


def _pruned_train_sql():
    """Lloyd passes over list columns: nearest centre, then means per cluster and coordinate."""
    ctes = _emb_near()[:2]
    prev = "c"
    for s in range(1, PRUNED_STEPS + 1):
        ctes += [
            S.cte(f"d{s}", "SELECT vec_id, cluster, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) "
                           f"AS dist2 FROM p, {prev}"),
            S.cte(f"a{s}", f"SELECT vec_id, arg_min(cluster, (dist2, cluster)) AS cluster FROM d{s} GROUP BY vec_id"),
            S.cte(f"u{s}", f"SELECT cluster, unnest(generate_series(1, {WIDE})) AS i, unnest(x) AS v FROM p JOIN a{s} USING (vec_id)"),
            S.cte(f"m{s}", "SELECT cluster, list(v ORDER BY i) AS c FROM (SELECT cluster, i, avg(v) AS v "
                           f"FROM u{s} GROUP BY cluster, i) GROUP BY cluster"),
            S.cte(f"c{s}", f"SELECT o.cluster, coalesce(m.c, o.c) AS c FROM {prev} o LEFT JOIN m{s} m USING (cluster)")]
        prev = f"c{s}"
    return S.with_(ctes, f"SELECT cluster, CAST(i - 1 AS INTEGER) AS dim, CAST(round(v, 6) AS DOUBLE) AS value FROM "
                         f"(SELECT cluster, unnest(generate_series(1, {WIDE})) AS i, unnest(c) AS v FROM {prev})")


@query("kmeans_pruned_train", _pruned_train_sql)
def kmeans_pruned_train(spark, sf_dir):
    """C8/C9 with bounds between passes at k = 64, d = 64."""
    pts, start = emb_start(spark, sf_dir)
    model = kmeans_pruned.train(pts, start, max_iter=PRUNED_STEPS, epsilon=0.0)
    return C.long_form(model.centers_df(spark))


@query("kmeans_pruned_assign", lambda: S.with_(
    _li() + S.assign_ctes("a", "p", "c0", K, D, keep=["l_orderkey", "l_linenumber"]),
    "SELECT l_orderkey, l_linenumber, a AS cluster, CAST(round(dmin, 6) AS DOUBLE) AS dist2 FROM a"))
def kmeans_pruned_assign(spark, sf_dir):
    """C8/C11 by the norm bound, over lineitem."""
    pts, start = li_start(spark, sf_dir)
    return kmeans_pruned.assign(pts, start, keep=LI_KEEP).select(*LI_KEEP, "cluster", F.round("dist2", 6).alias("dist2"))
