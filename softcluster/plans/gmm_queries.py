"""Registered Gaussian-mixture queries (section E) and their oracles.

Points: lineitem (quantity, price/1000), k = 2.  Start mixture: the first
10 rows in (l_orderkey, l_linenumber, x0, x1) order as the drawn sample,
two slices of 5 (the sampling operator's output given, so both engines
start alike).  SQL uses the closed-form 2 x 2 inverse and determinant.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import mixture as G
from ..sources import points as P
from ..sources import store
from . import fixtures as X
from . import sqlgen as S
from .fuzzy_queries import LI_KEEP
from .registry import query

K, D, NS = 2, 2, 5
TOL = 0.01
EPS = G.EPSILON
ORDER = ["l_orderkey", "l_linenumber"]


def given_sample(pts):
    order = [F.col("l_orderkey"), F.col("l_linenumber"), F.col(P.FEATURES)[0],
             F.col(P.FEATURES)[1]]
    smp = pts.orderBy(*order).limit(K * NS)
    w = Window.orderBy(*order)  # K*NS rows only
    return smp.withColumn("slice", ((F.row_number().over(w) - 1) / NS).cast("int"))


def start(spark, sf_dir):
    pts = X.points_li2(spark, sf_dir)
    return pts, G.init_from_sample(given_sample(pts), K)


# --- SQL -------------------------------------------------------------------

PARAMS = [f"w{j}" for j in range(K)] + [f"mu{j}_{i}" for j in range(K) for i in range(D)] + \
    [f"s{j}_{a}{b}" for j in range(K) for a in range(D) for b in range(D) if a <= b]


def _start_sql():
    ctes = [S.li_points("p", dims=2),
            S.cte("smp", "SELECT *, CAST((row_number() OVER (ORDER BY l_orderkey, l_linenumber, "
                         "x0, x1) - 1) // 5 AS INTEGER) AS slice FROM p "
                         f"ORDER BY l_orderkey, l_linenumber, x0, x1 LIMIT {K * NS}")]
    cols = []
    for j in range(K):
        cols.append(f"{1.0 / K!r} AS w{j}")
        for i in range(D):
            cols.append(f"avg(CASE WHEN slice = {j} THEN x{i} END) AS mu{j}_{i}")
        cols.append(f"var_pop(CASE WHEN slice = {j} THEN x0 END) AS s{j}_00")
        cols.append(f"0.0 AS s{j}_01")
        cols.append(f"var_pop(CASE WHEN slice = {j} THEN x1 END) AS s{j}_11")
    ctes.append(S.cte("g0", f"SELECT {', '.join(cols)} FROM smp"))
    return ctes


def _estep(name, g):
    """Rows with responsibilities r_j and lg = log(sum p) under mixture ``g``."""
    sel = []
    for j in range(K):
        det = f"({g}.s{j}_00 * {g}.s{j}_11 - {g}.s{j}_01 * {g}.s{j}_01)"
        dx, dy = f"(x0 - {g}.mu{j}_0)", f"(x1 - {g}.mu{j}_1)"
        q = (f"(({g}.s{j}_11 * {dx} * {dx} - 2.0 * {g}.s{j}_01 * {dx} * {dy} + "
             f"{g}.s{j}_00 * {dy} * {dy}) / {det})")
        sel.append(f"{EPS!r} + {g}.w{j} * exp(-0.5 * ({D}.0 * ln({2 * math.pi!r}) + ln({det})) "
                   f"- 0.5 * {q}) AS q{j}")
    tot = " + ".join(f"q{j}" for j in range(K))
    return [S.cte(f"{name}_q", f"SELECT p.*, {', '.join(sel)} FROM p, {g}"),
            S.cte(name, f"SELECT *, {', '.join(f'q{j} / ({tot}) AS r{j}' for j in range(K))}, "
                        f"ln({tot}) AS lg FROM {name}_q")]


def _sums(name, e):
    cols = ["sum(lg) AS llh", "count(*) AS n"]
    for j in range(K):
        cols.append(f"sum(r{j}) AS t{j}")
        cols += [f"sum(r{j} * x{i}) AS tx{j}_{i}" for i in range(D)]
        cols += [f"sum(r{j} * x{a} * x{b}) AS txx{j}_{a}{b}"
                 for a in range(D) for b in range(D) if a <= b]
    return S.cte(name, f"SELECT {', '.join(cols)} FROM {e}")


def _mstep_cols(t):
    tot = " + ".join(f"{t}.t{j}" for j in range(K))
    out = {}
    for j in range(K):
        out[f"w{j}"] = f"{t}.t{j} / ({tot})"
        for i in range(D):
            out[f"mu{j}_{i}"] = f"{t}.tx{j}_{i} / {t}.t{j}"
        for a in range(D):
            for b in range(D):
                if a <= b:
                    out[f"s{j}_{a}{b}"] = (f"{t}.txx{j}_{a}{b} / {t}.t{j} - "
                                           f"({t}.tx{j}_{a} / {t}.t{j}) * ({t}.tx{j}_{b} / {t}.t{j})")
    return out


def _chain(steps, flagged=False):
    """EM steps from g0.  ``flagged`` carries the stop rule |llh - llhp| > tol."""
    ctes = _start_sql()
    if flagged:
        ctes.append(S.cte("h0", "SELECT *, CAST('-1.7976931348623157e308' AS DOUBLE) AS llh, "
                                "0.0 AS llhp FROM g0"))
    prev = "h0" if flagged else "g0"
    for t in range(1, steps + 1):
        ctes += _estep(f"e{t}", prev)
        ctes.append(_sums(f"t{t}", f"e{t}"))
        m = _mstep_cols(f"t{t}")
        if flagged:
            act = f"abs(h.llh - h.llhp) > {TOL!r}"
            cols = [f"CASE WHEN {act} THEN {m[c]} ELSE h.{c} END AS {c}" for c in PARAMS]
            cols += [f"CASE WHEN {act} THEN t{t}.llh ELSE h.llh END AS llh",
                     f"CASE WHEN {act} THEN h.llh ELSE h.llhp END AS llhp"]
            ctes.append(S.cte(f"h{t}", f"SELECT {', '.join(cols)} FROM {prev} h, t{t}"))
            prev = f"h{t}"
        else:
            cols = [f"{m[c]} AS {c}" for c in PARAMS] + [f"t{t}.llh AS llh"]
            ctes.append(S.cte(f"g{t}", f"SELECT {', '.join(cols)} FROM t{t}"))
            prev = f"g{t}"
    return ctes, prev


def _components_sql(g):
    return "\nUNION ALL\n".join(
        f"SELECT CAST({j} AS INTEGER) AS component, CAST(round(w{j}, 6) AS DOUBLE) AS weight, "
        f"CAST(round(mu{j}_0, 6) AS DOUBLE) AS mu0, CAST(round(mu{j}_1, 6) AS DOUBLE) AS mu1, "
        f"CAST(round(s{j}_00, 6) AS DOUBLE) AS s00, CAST(round(s{j}_01, 6) AS DOUBLE) AS s01, "
        f"CAST(round(s{j}_11, 6) AS DOUBLE) AS s11 FROM {g}" for j in range(K))


def _components_out(spark, mix):
    rows = [(j, round(float(mix.weights[j]), 6), round(float(mix.mus[j][0]), 6),
             round(float(mix.mus[j][1]), 6), round(float(mix.sigmas[j][0][0]), 6),
             round(float(mix.sigmas[j][0][1]), 6), round(float(mix.sigmas[j][1][1]), 6))
            for j in range(mix.k)]
    return spark.createDataFrame(rows, "component int, weight double, mu0 double, mu1 double, "
                                       "s00 double, s01 double, s11 double")


def _components_df(df):
    """Components table -> the flat, rounded form the oracle emits (JVM-side)."""
    r6 = lambda c: F.round(c, 6)
    return df.select("component", r6("weight").alias("weight"),
                     r6(F.col("mu")[0]).alias("mu0"), r6(F.col("mu")[1]).alias("mu1"),
                     r6(F.col("sigma")[0][0]).alias("s00"), r6(F.col("sigma")[0][1]).alias("s01"),
                     r6(F.col("sigma")[1][1]).alias("s11"))


# E2 -------------------------------------------------------------------------

@query("gmm_init_from_sample", lambda: S.with_(_start_sql(), _components_sql("g0")))
def gmm_init_from_sample(spark, sf_dir):
    """E2 from a given sample: per-slice mean and diagonal biased variance."""
    _, mix = start(spark, sf_dir)
    return _components_out(spark, mix)


# E3 -------------------------------------------------------------------------

def _estep_sql():
    ctes = _start_sql() + _estep("e1", "g0") + [_sums("t1", "e1")]
    rows = []
    for j in range(K):
        rows.append(
            f"SELECT CAST({j} AS INTEGER) AS component, CAST(round(t{j} / n, 6) AS DOUBLE) AS resp, "
            f"CAST(round(tx{j}_0 / t{j}, 6) AS DOUBLE) AS mx0, CAST(round(tx{j}_1 / t{j}, 6) AS DOUBLE) AS mx1, "
            f"CAST(round(txx{j}_00 / t{j}, 4) AS DOUBLE) AS mxx00, "
            f"CAST(round(txx{j}_01 / t{j}, 4) AS DOUBLE) AS mxx01, "
            f"CAST(round(txx{j}_11 / t{j}, 4) AS DOUBLE) AS mxx11, "
            f"CAST(round(llh / n, 6) AS DOUBLE) AS llh_row FROM t1")
    return S.with_(ctes, "\nUNION ALL\n".join(rows))


@query("gmm_estep", _estep_sql)
def gmm_estep(spark, sf_dir):
    """E3 E-part: responsibility sums per component, scaled per row/weight."""
    pts, mix = start(spark, sf_dir)
    sums = G.estep_sums(pts, mix)
    n = pts.count()
    rows = []
    for j in range(K):
        s = sums[j]
        vals = (s[0] / n, s[1] / s[0], s[2] / s[0], s[3] / s[0], s[4] / s[0], s[6] / s[0],
                sums[K, 0] / n)
        digits = (6, 6, 6, 4, 4, 4, 6)
        rows.append((j, *[round(float(v), dg) for v, dg in zip(vals, digits)]))
    return spark.createDataFrame(rows, "component int, resp double, mx0 double, mx1 double, "
                                       "mxx00 double, mxx01 double, mxx11 double, llh_row double")


def _step_sql():
    ctes, last = _chain(1)
    return S.with_(ctes, _components_sql(last))


@query("gmm_step", _step_sql)
def gmm_step(spark, sf_dir):
    """One EM step."""
    pts, mix = start(spark, sf_dir)
    new, _ = G.em_step(pts, mix)
    return _components_out(spark, new)


# E1 / E4 / E7 ------------------------------------------------------------------

def _train_sql():
    ctes, last = _chain(2)
    return S.with_(ctes, _components_sql(last))


@query("gmm_train", _train_sql)
def gmm_train(spark, sf_dir):
    """EM with max 2 iterations, tol 0.01."""
    pts, mix = start(spark, sf_dir)
    return _components_out(spark, G.train(pts, k=K, max_iter=2, tol=TOL, init=mix))


WARM_ITERS = 8


def _warm_sql():
    ctes, last = _chain(WARM_ITERS, flagged=True)
    return S.with_(ctes, _components_sql(last))


@query("gmm_warm_start", _warm_sql)
def gmm_warm_start(spark, sf_dir):
    """Warm start from a components table, stop rule |llh - prev| <= 0.01."""
    pts, mix = start(spark, sf_dir)
    comp = mix.to_df(spark)
    return _components_out(spark, G.train(pts, k=K, max_iter=WARM_ITERS, tol=TOL, init=comp))


def _loglik_sql():
    ctes, _ = _chain(3)
    body = "\nUNION ALL\n".join(
        f"SELECT CAST({t} AS INTEGER) AS iteration, CAST(round(llh, 4) AS DOUBLE) AS llh FROM t{t}"
        for t in range(1, 4))
    return S.with_(ctes, body)


@query("gmm_loglik", _loglik_sql)
def gmm_loglik(spark, sf_dir):
    """Log-likelihood per iteration as a trace table."""
    pts, mix = start(spark, sf_dir)
    fit = G.train(pts, k=K, max_iter=3, tol=-1.0, init=mix)
    return G.trace_df(spark, fit).select("iteration", F.round("llh", 4).alias("llh"))


# E5 / E6 ------------------------------------------------------------------------

def _soft_sql():
    ctes = _start_sql() + _estep("e1", "g0")
    body = "\nUNION ALL\n".join(
        f"SELECT l_orderkey, l_linenumber, CAST({j} AS INTEGER) AS component, "
        f"CAST(round(r{j}, 6) AS DOUBLE) AS probability FROM e1" for j in range(K))
    return S.with_(ctes, body)


@query("gmm_predict_soft", _soft_sql)
def gmm_predict_soft(spark, sf_dir):
    pts, mix = start(spark, sf_dir)
    out = G.predict_soft(pts, mix, keep=LI_KEEP)
    return out.select(*LI_KEEP, F.posexplode("probability").alias("component", "probability")
                      ).select(*LI_KEEP, F.col("component").cast("int").alias("component"),
                               F.round("probability", 6).alias("probability"))


def _predict_sql():
    ctes = _start_sql() + _estep("e1", "g0")
    return S.with_(ctes, f"SELECT l_orderkey, l_linenumber, {S.argmax_expr(K, 'r')} AS prediction "
                         f"FROM e1")


@query("gmm_predict", _predict_sql)
def gmm_predict(spark, sf_dir):
    pts, mix = start(spark, sf_dir)
    return G.predict(pts, mix, keep=LI_KEEP).select(*LI_KEEP, "prediction")


# A8 ---------------------------------------------------------------------------

@query("gmm_model_roundtrip", _step_sql)
def gmm_model_roundtrip(spark, sf_dir):
    """Save the one-step mixture as parquet, load it back (sizes checked)."""
    pts, mix = start(spark, sf_dir)
    new, _ = G.em_step(pts, mix)
    path = store.save_mixture(new.to_df(spark))
    return _components_df(store.load_mixture(spark, path))


@query("gmm_table_train", _train_sql)
def gmm_table_train(spark, sf_dir):
    """E1/E3 with the components as a table: two steps."""
    from ..operators import mixture_table
    pts, mix = start(spark, sf_dir)
    model = mixture_table.train(pts, mix.to_df(spark), max_iter=2, tol=TOL)
    return _components_out(spark, G.Mixture.from_df(model.components()))
