"""Registered fuzzy c-means queries (section B) and their oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import centers as C
from ..functions import draws
from ..operators import fuzzy
from ..sources import points as P
from . import fixtures as X
from . import sqlgen as S
from .registry import query

K, D, M, STEPS = 4, 4, 2.0, 3
LI_KEEP = ["l_orderkey", "l_linenumber"]
GROUP_SQL = "floor(x0 / 13)"


def li_start(spark, sf_dir):
    pts = X.points_li(spark, sf_dir)
    start = C.from_df(C.group_means(pts, X.quantity_groups(pts), dim=D))
    return pts, start


def ev_start(spark, sf_dir):
    """events start centres: per 6-hour block of the day (4 groups)."""
    pts = X.points_ev(spark, sf_dir)
    start = C.from_df(C.group_means(pts, F.floor(F.col(P.FEATURES)[1] * 4.0), dim=2))
    return pts, start


def _li_prefix():
    return [S.li_points("p"), S.group_mean_centers("c0", "p", GROUP_SQL, K, D)]


def _ev_prefix():
    return [S.ev_points("p"), S.group_mean_centers("c0", "p", "floor(x1 * 4.0)", K, 2)]


# B1 -------------------------------------------------------------------------

def _fcm_train_sql():
    ctes = _li_prefix()
    for s in range(1, STEPS + 1):
        ctes += S.fuzzy_step(f"c{s}", "p", f"c{s - 1}", K, D, M)
    return S.with_(ctes, S.centers_long(f"c{STEPS}", K, D))


@query("fcm_train", _fcm_train_sql)
def fcm_train(spark, sf_dir):
    """B1: 3 passes from group-mean centres, epsilon 0 (fixed passes)."""
    pts, start = li_start(spark, sf_dir)
    model = fuzzy.train(pts, k=K, m=M, max_iter=STEPS, epsilon=0.0, init=start)
    return C.long_form(model.centers_df(spark))


# B3 -------------------------------------------------------------------------

def _fcm_step_sql():
    ctes = _li_prefix()
    mem = S.fuzzy_memberships("u", "p", "c0", K, D, M, keep=[])
    sel = "\nUNION ALL\n".join(
        f"SELECT CAST({j} AS INTEGER) AS cluster, CAST(round(sum(um{j}), 4) AS DOUBLE) AS weight, "
        f"CAST({i} AS INTEGER) AS dim, CAST(round(sum(um{j} * x{i}) / sum(um{j}), 6) AS DOUBLE) AS value "
        f"FROM u_m" for j in range(K) for i in range(D))
    return S.with_(ctes + mem, sel)


@query("fcm_step", _fcm_step_sql)
def fcm_step(spark, sf_dir):
    """B3 through the all-JVM twin (posexplode + groupBy)."""
    pts, start = li_start(spark, sf_dir)
    out = fuzzy.center_step_columns(pts, start, M)
    return out.select(
        "cluster", F.round("weight", 4).alias("weight"),
        F.posexplode("center").alias("dim", "value")).select(
        "cluster", "weight", F.col("dim").cast("int").alias("dim"),
        F.round("value", 6).alias("value"))


# B4 -------------------------------------------------------------------------

def _fcm_shift_sql():
    ctes = _li_prefix() + S.fuzzy_step("c1", "p", "c0", K, D, M)
    rows = []
    for j in range(K):
        s2 = " + ".join(f"(c1.{S.ccol(j, i)} - c0.{S.ccol(j, i)}) * "
                        f"(c1.{S.ccol(j, i)} - c0.{S.ccol(j, i)})" for i in range(D))
        rows.append(f"SELECT CAST({j} AS INTEGER) AS cluster, CAST(round({s2}, 6) AS DOUBLE) AS shift2, "
                    f"({s2}) > {1e-4 * 1e-4!r} AS moved FROM c0, c1")
    return S.with_(ctes, "\nUNION ALL\n".join(rows))


@query("fcm_center_shift", _fcm_shift_sql)
def fcm_center_shift(spark, sf_dir):
    pts, start = li_start(spark, sf_dir)
    new = fuzzy.center_step(pts, start, M)
    out = fuzzy.center_shift(C.to_df(spark, start), new.select("cluster", "center"), 1e-4)
    return out.select("cluster", F.round("shift2", 6).alias("shift2"), "moved")


# B5 / B6 ----------------------------------------------------------------------

def _fcm_membership_sql():
    ctes = _li_prefix() + S.fuzzy_memberships("u", "p", "c0", K, D, M, keep=LI_KEEP)
    body = S.unpivot("u_m", LI_KEEP, K, {
        "u": "CAST(round(u{j}, 6) AS DOUBLE)",
        "u_m": "CAST(round(um{j}, 6) AS DOUBLE)"})
    return S.with_(ctes, body)


@query("fcm_membership", _fcm_membership_sql)
def fcm_membership(spark, sf_dir):
    pts, start = li_start(spark, sf_dir)
    mem = fuzzy.membership(pts, start, M, keep=LI_KEEP)
    return mem.select(*LI_KEEP, "cluster", F.round("u", 6).alias("u"),
                      F.round("u_m", 6).alias("u_m"))


def _fcm_predict_sql():
    ctes = _li_prefix() + S.fuzzy_memberships("u", "p", "c0", K, D, M, keep=LI_KEEP)
    return S.with_(ctes, f"SELECT l_orderkey, l_linenumber, {S.argmax_expr(K, 'u')} "
                         f"AS prediction FROM u")


@query("fcm_predict", _fcm_predict_sql)
def fcm_predict(spark, sf_dir):
    pts, start = li_start(spark, sf_dir)
    return fuzzy.predict(pts, start, M).select(*LI_KEEP, "prediction")


# B7 -------------------------------------------------------------------------

def _fcm_objective_sql():
    ctes = _li_prefix() + S.fuzzy_memberships("u", "p", "c0", K, D, M, keep=[])
    total = " + ".join(f"sum(um{j} * d{j})" for j in range(K))
    return S.with_(ctes, f"SELECT CAST(round({total}, 4) AS DOUBLE) AS objective FROM u_m")


@query("fcm_objective", _fcm_objective_sql)
def fcm_objective(spark, sf_dir):
    """Fuzzy objective sum u^m d, the score that picks the best run."""
    pts, start = li_start(spark, sf_dir)
    d = start.shape[1]
    sums = fuzzy.step_sums(pts, start, M)
    return spark.createDataFrame([(float(np.round(sums[:, d + 1].sum(), 4)),)],
                                 "objective double")


RUNS, RUN_STEPS = 3, 2


def _best_run_sql():
    ctes = _li_prefix()
    for r in range(RUNS):
        cols = ", ".join(f"{S.ccol(j, i)} * {1.0 + 0.3 * r!r} AS {S.ccol(j, i)}" for j in range(K) for i in range(D))
        ctes.append(S.cte(f"r{r}_0", f"SELECT {cols} FROM c0"))
        for t in range(RUN_STEPS):
            ctes += S.fuzzy_step(f"r{r}_{t + 1}", "p", f"r{r}_{t}", K, D, M)
        ctes += S.fuzzy_memberships(f"o{r}", "p", f"r{r}_{RUN_STEPS}", K, D, M, keep=[])
        total = " + ".join(f"sum(um{j} * d{j})" for j in range(K))
        ctes.append(S.cte(f"b{r}", f"SELECT {r} AS run, {total} AS objective FROM o{r}_m"))
    ctes.append(S.cte("b", " UNION ALL ".join(f"SELECT * FROM b{r}" for r in range(RUNS))))
    ctes.append(S.cte("w", "SELECT w.* FROM (" + " UNION ALL ".join(
        f"SELECT {r} AS run, * FROM r{r}_{RUN_STEPS}" for r in range(RUNS)) +
        ") w WHERE run = (SELECT arg_min(run, objective) FROM b)"))
    return S.with_(ctes, S.centers_long("w", K, D))


@query("fcm_best_run", _best_run_sql)
def fcm_best_run(spark, sf_dir):
    """Three runs in shared passes; the lowest final objective wins."""
    pts, start = li_start(spark, sf_dir)
    starts = np.stack([start * (1.0 + 0.3 * r) for r in range(RUNS)])
    model = fuzzy.train(pts, k=K, m=M, max_iter=RUN_STEPS, epsilon=0.0, init=starts)
    return C.long_form(model.centers_df(spark))


# B8 -------------------------------------------------------------------------

def _fcm_delta_sql():
    ctes = _ev_prefix() + S.fuzzy_step("c1", "p", "c0", K, 2, M)
    ctes += S.fuzzy_memberships("a", "p", "c0", K, 2, M, keep=["event_id"])
    ctes += S.fuzzy_memberships("b", "p", "c1", K, 2, M, keep=["event_id"])
    diff = " + ".join(f"(a.u{j} - b.u{j}) * (a.u{j} - b.u{j})" for j in range(K))
    return S.with_(ctes, f"SELECT CAST(round(sqrt(sum({diff})), 6) AS DOUBLE) AS delta "
                         f"FROM a JOIN b USING (event_id)")


@query("fcm_membership_delta", _fcm_delta_sql)
def fcm_membership_delta(spark, sf_dir):
    """Frobenius norm of the membership change over one pass (events)."""
    pts, start = ev_start(spark, sf_dir)
    new = C.from_df(fuzzy.center_step(pts, start, M).select("cluster", "center"))
    a = fuzzy.membership(pts, start, M, keep=["event_id"])
    b = fuzzy.membership(pts, new, M, keep=["event_id"])
    out = fuzzy.membership_delta(a, b, keys=("event_id",))
    return out.select(F.round("delta", 6).alias("delta"))


# Draws keyed by the rows' values and ids ---------------------------------

def value_key():
    """A point as text that both engines write alike: millionths, as integers."""
    return F.array_join(F.transform(P.FEATURES, lambda x: F.floor(x * 1e6 + 0.5).cast("string")), ",")


VALUE_KEY_SQL = "concat_ws(',', " + ", ".join(f"CAST(floor(x{i} * 1e6 + 0.5) AS BIGINT)" for i in range(D)) + ")"


def drawn_sql(rows, draw):
    """The first K of ``rows`` by ``draw``, then by value, in long form."""
    xs = ", ".join(f"x{i}" for i in range(D))
    first = S.cte("f", f"SELECT row_number() OVER (ORDER BY u, {xs}) - 1 AS j, {xs} FROM (SELECT *, {draw} AS u FROM ({rows})) "
                       f"QUALIFY j < {K}")
    return S.with_([S.li_points("p"), first], "\nUNION ALL\n".join(
        f"SELECT CAST(j AS INTEGER) AS cluster, CAST({i} AS INTEGER) AS dim, CAST(round(x{i}, 6) AS DOUBLE) AS value FROM f" for i in range(D)))


@query("fcm_init_random", lambda: drawn_sql(
    "SELECT DISTINCT " + ", ".join(f"x{i}" for i in range(D)) + " FROM p", draws.uniform_sql(7, VALUE_KEY_SQL)))
def fcm_init_random(spark, sf_dir):
    """B2: distinct rows of the least draws."""
    pts = X.points_li(spark, sf_dir)
    return C.long_form(C.to_df(spark, fuzzy.init_random(pts, K, seed=7, key=value_key())))


def _init_membership_sql():
    us = [draws.uniform_sql(11, "event_id", str(j)) for j in range(K)]
    ctes = [S.ev_points("p"), S.cte("r", "SELECT event_id, " + ", ".join(f"{u} AS r{j}" for j, u in enumerate(us)) + " FROM p")]
    total = " + ".join(f"r{j}" for j in range(K))
    return S.with_(ctes, "\nUNION ALL\n".join(
        f"SELECT event_id, CAST({j} AS INTEGER) AS cluster, CAST(round(r{j} / ({total}), 12) AS DOUBLE) AS u FROM r" for j in range(K)))


@query("fcm_init_membership", _init_membership_sql)
def fcm_init_membership(spark, sf_dir):
    """Memberships drawn by row id."""
    u = fuzzy.init_membership(X.points_ev(spark, sf_dir), K, seed=11, id_col="event_id")
    return u.withColumn("u", F.round("u", 12))


# A7 ---------------------------------------------------------------------------

@query("fcm_model_roundtrip", _fcm_train_sql)
def fcm_model_roundtrip(spark, sf_dir):
    """Fuzzy centres saved with m and epsilon in meta, loaded with checks."""
    from ..sources import store
    pts, start = li_start(spark, sf_dir)
    model = fuzzy.train(pts, k=K, m=M, max_iter=STEPS, epsilon=0.0, init=start)
    path = store.save_fuzzy(model.centers_df(spark), model.m, model.epsilon)
    centers, meta = store.load_fuzzy(spark, path)
    assert meta["m"] == M and meta["k"] == K
    return C.long_form(centers)
