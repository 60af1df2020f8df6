"""Registered bisecting k-means queries (section D) and their oracles.

Oracles use a fixed split noise, noise_i = (i + 1) / (d + 1), so both engines
start every split from the same child centres.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import bisecting as B
from ..sources import points as P
from . import fixtures as X
from . import sqlgen as S
from .fuzzy_queries import GROUP_SQL, LI_KEEP
from .registry import query

D, ITERS = 4, 20
# Tree centres include the root: the mean of 2-decimal columns over all
# 60,000 rows, which at 6 decimals sits exactly on a rounding half for 1 in 6
# sums; at 7 decimals it never does, so both engines round alike.
TREE_DIGITS = 7
NOISE = [(i + 1) / (D + 1) for i in range(D)]
EPS = B.EPSILON


def _nz(i):
    return repr(float(NOISE[i]))


def li_nodes(spark, sf_dir):
    """points_li with node = 4 + floor(quantity/13): four level-2 nodes."""
    pts = X.points_li(spark, sf_dir)
    return pts.withColumn("node", (F.lit(4) + F.floor(F.col(P.FEATURES)[0] / 13.0)).cast("long"))


def _nodes_sql():
    return [S.li_points("p0"),
            S.cte("p", f"SELECT *, CAST(4 + {GROUP_SQL} AS BIGINT) AS node FROM p0")]


def _sumsq(prefix="x"):
    return " + ".join(f"{prefix}{i} * {prefix}{i}" for i in range(D))


def _summary_cte(name, src, by):
    means = ", ".join(f"sum(x{i}) * (1.0 / count(*)) AS m{i}" for i in range(D))
    return S.cte(name, f"SELECT {by} AS node, count(*) AS n, {means}, sum({_sumsq()}) AS ss "
                       f"FROM {src} GROUP BY {by}")


def _cost(n="n", m="m", ss="ss"):
    mm = " + ".join(f"{m}{i} * {m}{i}" for i in range(D))
    return f"greatest({ss} - {n} * ({mm}), 0.0)"


# D2 ---------------------------------------------------------------------------

def _summary_sql():
    ctes = _nodes_sql() + [_summary_cte("s", "p", "node")]
    body = "\nUNION ALL\n".join(
        f"SELECT node, n AS size, CAST(round({_cost()}, 2) AS DOUBLE) AS cost, "
        f"CAST({i} AS INTEGER) AS dim, CAST(round(m{i}, 6) AS DOUBLE) AS value FROM s"
        for i in range(D))
    return S.with_(ctes, body)


def _summary_rows(spark, summ):
    rows = [(int(nd), int(s.size), float(round(s.cost, 2)), i, float(round(v, 6)))
            for nd, s in summ.items() for i, v in enumerate(s.center)]
    return spark.createDataFrame(rows, "node long, size long, cost double, dim int, value double")


@query("bisecting_summary", _summary_sql)
def bisecting_summary(spark, sf_dir):
    """Size, mean, cost = max(sum|x|^2 - n|mean|^2, 0) per node."""
    pts = li_nodes(spark, sf_dir)
    return _summary_rows(spark, B.summarize(pts, [4, 5, 6, 7]))


# D3 ---------------------------------------------------------------------------

MIN_SIZE, NEEDED = 15000, 2


def _divisible_sql():
    ctes = _nodes_sql() + [_summary_cte("s", "p", "node")]
    return S.with_(ctes, f"SELECT node FROM s WHERE n >= {MIN_SIZE} AND {_cost()} > {EPS!r} * n "
                         f"ORDER BY n DESC, node LIMIT {NEEDED}")


@query("bisecting_divisible", _divisible_sql)
def bisecting_divisible(spark, sf_dir):
    """D3: nodes of >= 15000 rows with real cost, the 2 largest."""
    pts = li_nodes(spark, sf_dir)
    div = B.divisible(B.summarize(pts, [4, 5, 6, 7]), MIN_SIZE, NEEDED)
    return spark.createDataFrame([(int(n),) for n in div], "node long")


# D4 ---------------------------------------------------------------------------

DIVIDED = (4, 6)


def _split_cols(src, m="m", name_l="l", name_r="r"):
    lvl = f"(1e-4 * sqrt({' + '.join(f'{m}{i} * {m}{i}' for i in range(D))}))"
    cols = [f"{m}{i} - {lvl} * {_nz(i)} AS {name_l}{i}" for i in range(D)]
    cols += [f"{m}{i} + {lvl} * {_nz(i)} AS {name_r}{i}" for i in range(D)]
    return ", ".join(cols)


def _reassign_sql():
    ctes = _nodes_sql() + [_summary_cte("s", "p", "node"),
                           S.cte("ch", f"SELECT node, {_split_cols('s')} FROM s "
                                       f"WHERE node IN {DIVIDED}")]
    dl = " + ".join(f"(x{i} - l{i}) * (x{i} - l{i})" for i in range(D))
    dr = " + ".join(f"(x{i} - r{i}) * (x{i} - r{i})" for i in range(D))
    body = (f"SELECT l_orderkey, l_linenumber, CASE WHEN ch.node IS NULL THEN p.node "
            f"WHEN {dl} <= {dr} THEN 2 * p.node ELSE 2 * p.node + 1 END AS node "
            f"FROM p LEFT JOIN ch ON p.node = ch.node")
    return S.with_(ctes, body)


@query("bisecting_reassign", _reassign_sql)
def bisecting_reassign(spark, sf_dir):
    """Rows of nodes 4 and 6 move to their nearer child; others stay."""
    pts = li_nodes(spark, sf_dir)
    summ = B.summarize(pts, [4, 5, 6, 7])
    centers = {}
    for n in DIVIDED:
        centers[2 * n], centers[2 * n + 1] = B.split_center(summ[n].center, np.array(NOISE))
    return B.reassign(pts, centers).select(*LI_KEEP, "node")


# Full runs with the fixed noise ----------------------------------------

def _two_means(prefix, src, start_row, steps=ITERS):
    """2-means chain from one row holding l0.., r0.. (left/right starts)."""
    cols = ", ".join([f"l{i} AS {S.ccol(0, i)}" for i in range(D)] +
                     [f"r{i} AS {S.ccol(1, i)}" for i in range(D)])
    ctes = [S.cte(f"{prefix}_st", f"SELECT {cols} FROM {start_row}")]
    chain, last = S.kmeans_chain(f"{prefix}_", src, f"{prefix}_st", 2, D, steps, 0.0)
    return ctes + chain, f"{prefix}_{steps}_a", last


def _level_summary(name, assigned, base):
    """Child summaries from the last pass's assignment: raw = 2*base + a."""
    means = ", ".join(f"sum(x{i}) * (1.0 / count(*)) AS m{i}" for i in range(D))
    return S.cte(name, f"SELECT {base} * 2 + a AS node, count(*) AS n, {means}, "
                       f"sum({_sumsq()}) AS ss FROM {assigned} GROUP BY a")


def _tree_ctes(levels: int):
    """CTEs ending in ``tree``: (raw, node_index, parent, size, cost, height,
    is_leaf, m0..) for a run with k = levels + 1 leaves (1 or 2 levels)."""
    ctes = [S.li_points("p")]
    ctes.append(S.cte("root", f"SELECT CAST(1 AS BIGINT) AS node, count(*) AS n, "
                              + ", ".join(f"sum(x{i}) * (1.0 / count(*)) AS m{i}" for i in range(D))
                              + f", sum({_sumsq()}) AS ss FROM p"))
    ctes.append(S.cte("st1", f"SELECT {_split_cols('root')} FROM root"))
    ch, assigned, _ = _two_means("a", "p", "st1")
    ctes += ch + [_level_summary("lv1", assigned, "1")]
    nodes = ["SELECT node, n, " + ", ".join(f"m{i}" for i in range(D)) + ", ss FROM root",
             "SELECT node, n, " + ", ".join(f"m{i}" for i in range(D)) + ", ss FROM lv1"]
    if levels == 2:
        # The larger child (lower id on ties) is divided next, by the summary
        # means; rows go to it by the final level-1 assignment.
        ctes.append(S.cte("big", "SELECT node FROM lv1 ORDER BY n DESC, node LIMIT 1"))
        cc = ", ".join(f"max(CASE WHEN node = 2 THEN m{i} END) AS {S.ccol(0, i)}, "
                       f"max(CASE WHEN node = 3 THEN m{i} END) AS {S.ccol(1, i)}" for i in range(D))
        ctes.append(S.cte("lc", f"SELECT {cc} FROM lv1"))
        ctes += S.assign_ctes("f1", "p", "lc", 2, D, keep=[])
        ctes.append(S.cte("p2", "SELECT * FROM f1 WHERE 2 + a = (SELECT node FROM big)"))
        ctes.append(S.cte("st2", f"SELECT {_split_cols('lv1')} FROM lv1 "
                                 f"WHERE node = (SELECT node FROM big)"))
        ch2, assigned2, _ = _two_means("b", "p2", "st2")
        ctes += ch2 + [_level_summary("lv2", assigned2, "(SELECT node FROM big)")]
        nodes.append("SELECT node, n, " + ", ".join(f"m{i}" for i in range(D)) + ", ss FROM lv2")
    ctes.append(S.cte("nodes", "\nUNION ALL\n".join(nodes)))
    dist = " + ".join(f"(a.m{i} - c.m{i}) * (a.m{i} - c.m{i})" for i in range(D))
    ctes.append(S.cte("heights", f"SELECT a.node, sqrt(max({dist})) AS height FROM nodes a "
                                 f"JOIN nodes c ON c.node IN (2 * a.node, 2 * a.node + 1) "
                                 f"GROUP BY a.node"))
    if levels == 1:
        idx = "CASE node WHEN 1 THEN -1 WHEN 2 THEN 0 ELSE 1 END"
    else:
        idx = ("CASE WHEN (SELECT node FROM big) = 2 THEN "
               "(CASE node WHEN 1 THEN -1 WHEN 2 THEN -2 WHEN 4 THEN 0 WHEN 5 THEN 1 ELSE 2 END) "
               "ELSE (CASE node WHEN 1 THEN -1 WHEN 2 THEN 0 WHEN 3 THEN -2 WHEN 6 THEN 1 ELSE 2 END) END")
    ms = ", ".join(f"m{i}" for i in range(D))
    ctes.append(S.cte("tree", f"SELECT n.node AS raw, CAST({idx} AS INTEGER) AS node_index, "
                              f"CASE WHEN n.node = 1 THEN NULL ELSE n.node // 2 END AS parent, "
                              f"n.n AS size, {_cost('n.n', 'n.m', 'n.ss')} AS cost, "
                              f"coalesce(h.height, 0.0) AS height, h.node IS NULL AS is_leaf, {ms} "
                              f"FROM nodes n LEFT JOIN heights h USING (node)"))
    return ctes


def _tree_sql(levels):
    body = "\nUNION ALL\n".join(
        f"SELECT raw AS raw_index, node_index, parent AS parent_raw, size, "
        f"CAST(round(cost, 2) AS DOUBLE) AS cost, CAST(round(height, 6) AS DOUBLE) AS height, "
        f"is_leaf, CAST({i} AS INTEGER) AS dim, CAST(round(m{i}, {TREE_DIGITS}) AS DOUBLE) AS value "
        f"FROM tree" for i in range(D))
    return S.with_(_tree_ctes(levels), body)


def _tree_out(model, spark):
    t = model.tree_df(spark)
    return t.select("raw_index", "node_index", "parent_raw", "size",
                    F.round("cost", 2).alias("cost"), F.round("height", 6).alias("height"),
                    "is_leaf", F.posexplode("center").alias("dim", "value")).select(
        "raw_index", "node_index", "parent_raw", "size", "cost", "height", "is_leaf",
        F.col("dim").cast("int").alias("dim"), F.round("value", TREE_DIGITS).alias("value"))


def _model(spark, sf_dir, k):
    pts = X.points_li(spark, sf_dir)
    return B.train(pts, k=k, max_iter=ITERS, noise=np.array(NOISE))


@query("bisecting_one_level", lambda: _tree_sql(1))
def bisecting_one_level(spark, sf_dir):
    """D1 with k = 2: one division of the root, fixed noise."""
    return _tree_out(_model(spark, sf_dir, 2), spark)


@query("bisecting_tree", lambda: _tree_sql(2))
def bisecting_tree(spark, sf_dir):
    """k = 3, the tree with preorder leaf/internal indices and heights."""
    return _tree_out(_model(spark, sf_dir, 3), spark)


def _leaves_sql():
    body = "\nUNION ALL\n".join(
        f"SELECT node_index AS cluster, CAST({i} AS INTEGER) AS dim, "
        f"CAST(round(m{i}, 6) AS DOUBLE) AS value FROM tree WHERE is_leaf" for i in range(D))
    return S.with_(_tree_ctes(2), body)


@query("bisecting_leaves", _leaves_sql)
def bisecting_leaves(spark, sf_dir):
    """D5 leaf-centre listing."""
    from ..functions import centers as C
    return C.long_form(_model(spark, sf_dir, 3).leaves_df(spark))


def _descend_ctes():
    """Per row: child of the root, then of the divided child (left on ties)."""
    ctes = _tree_ctes(2)
    cc = ", ".join(f"max(CASE WHEN raw = {r} THEN m{i} END) AS t{r}_{i}"
                   for r in (2, 3, 4, 5, 6, 7) for i in range(D))
    ctes.append(S.cte("tw", f"SELECT {cc}, (SELECT node FROM big) AS big FROM tree"))

    def dist(r):
        return " + ".join(f"(x{i} - t{r}_{i}) * (x{i} - t{r}_{i})" for i in range(D))

    ctes.append(S.cte("w1", f"SELECT p.*, tw.*, {dist(2)} AS e2, {dist(3)} AS e3 FROM p, tw"))
    ctes.append(S.cte("w2", "SELECT *, CASE WHEN e2 <= e3 THEN 2 ELSE 3 END AS n1 FROM w1"))
    ctes.append(S.cte("w3", f"SELECT *, CASE WHEN n1 = big AND big = 2 THEN {dist(4)} "
                            f"WHEN n1 = big THEN {dist(6)} END AS e_l, "
                            f"CASE WHEN n1 = big AND big = 2 THEN {dist(5)} "
                            f"WHEN n1 = big THEN {dist(7)} END AS e_r FROM w2"))
    ctes.append(S.cte("walk", "SELECT *, CASE WHEN n1 <> big THEN n1 WHEN e_l <= e_r THEN 2 * n1 "
                              "ELSE 2 * n1 + 1 END AS leaf_raw, "
                              "CASE WHEN n1 <> big THEN (CASE WHEN n1 = 2 THEN e2 ELSE e3 END) "
                              "WHEN e_l <= e_r THEN e_l ELSE e_r END AS cost FROM w3"))
    return ctes


def _predict_sql():
    return S.with_(_descend_ctes(), "SELECT l_orderkey, l_linenumber, t.node_index AS prediction "
                                    "FROM walk JOIN tree t ON t.raw = walk.leaf_raw")


def _predict_df(spark, sf_dir, path=False):
    model = _model(spark, sf_dir, 3)
    pts = X.points_li(spark, sf_dir)
    return model.predict(pts, keep=LI_KEEP, path=path)


@query("bisecting_predict", _predict_sql)
def bisecting_predict(spark, sf_dir):
    """Level-by-level descent, not nearest leaf overall."""
    return _predict_df(spark, sf_dir).select(*LI_KEEP, "prediction")


def _path_sql():
    return S.with_(_descend_ctes(), "SELECT l_orderkey, l_linenumber, "
                                    "CASE WHEN n1 <> big THEN '1,' || n1 ELSE "
                                    "'1,' || n1 || ',' || leaf_raw END AS path FROM walk")


@query("bisecting_path", _path_sql)
def bisecting_path(spark, sf_dir):
    """Raw node ids from root to leaf, each once (Q13 fixed)."""
    out = _predict_df(spark, sf_dir, path=True)
    return out.select(*LI_KEEP, F.array_join(F.col("path").cast("array<string>"), ",")
                      .alias("path"))


def _cost_sql():
    return S.with_(_descend_ctes(), "SELECT CAST(round(sum(cost), 4) AS DOUBLE) AS cost FROM walk")


@query("bisecting_cost", _cost_sql)
def bisecting_cost(spark, sf_dir):
    """Total squared distance to the predicted leaf centre."""
    out = _predict_df(spark, sf_dir)
    return out.agg(F.round(F.sum("cost"), 4).alias("cost"))


@query("bisecting_train")
def bisecting_train(spark, sf_dir):
    """D1 defaults (k = 4, 20 passes, seeded uniform noise): rows-only."""
    pts = X.points_li(spark, sf_dir)
    return _tree_out(B.train(pts, k=4, seed=17), spark)


# D1 over all levels: every node of a level is divided at once -----------------------

DEEP_K, DEEP_LEVELS = 6, 3


def _both(left, right, what):
    """SQL columns what(i) for the left and the right child."""
    return ", ".join(f"{what(side, i)} AS {name}{i}" for side, name in ((0, left), (1, right)) for i in range(D))


def _side(c):
    far = [" + ".join(f"(p.x{i} - {c}.{s}{i}) * (p.x{i} - {c}.{s}{i})" for i in range(D)) for s in "lr"]
    return f"CASE WHEN {far[0]} <= {far[1]} THEN 0 ELSE 1 END"


def _deep_ctes():
    """CTEs ending in ``every``: node, n, m0.., ss, of a run of DEEP_LEVELS
    levels; each divides its largest open nodes until DEEP_K leaves."""
    xs = ", ".join(f"p.x{i}" for i in range(D))
    ms = ", ".join(f"m{i}" for i in range(D))
    moments = ", ".join([f"sum(x{i}) * (1.0 / count(*)) AS m{i}" for i in range(D)])
    ctes = [S.li_points("raw"),
            S.cte("rows0", "SELECT CAST(1 AS BIGINT) AS node, x0, x1, x2, x3 FROM raw"),
            S.cte("made0", f"SELECT node, count(*) AS n, {moments}, sum({_sumsq()}) AS ss FROM rows0 GROUP BY node"),
            S.cte("leaves0", "SELECT 1 AS leaves")]
    for v in range(DEEP_LEVELS):
        ctes += [
            S.cte(f"chosen{v}", f"SELECT * FROM made{v} WHERE n >= 1 AND {_cost()} > {EPS!r} * n "
                                f"QUALIFY row_number() OVER (ORDER BY n DESC, node) <= {DEEP_K} - (SELECT leaves FROM leaves{v})"),
            S.cte(f"open{v}", f"SELECT p.* FROM rows{v} p SEMI JOIN chosen{v} USING (node)"),
            S.cte(f"c{v}_0", f"SELECT node, {_split_cols(f'chosen{v}')} FROM chosen{v}")]
        for s in range(1, ITERS + 1):
            means = _both("l", "r", lambda side, i: f"coalesce(sum(x{i}) FILTER (a = {side}) * (1.0 / nullif(count(*) FILTER (a = {side}), 0)), 'inf'::DOUBLE)")
            ctes += [S.cte(f"a{v}_{s}", f"SELECT p.node, {xs}, {_side('c')} AS a FROM open{v} p JOIN c{v}_{s - 1} c USING (node)"),
                     S.cte(f"c{v}_{s}", f"SELECT node, {means} FROM a{v}_{s} GROUP BY node")]
        ctes += [
            S.cte(f"made{v + 1}", f"SELECT 2 * node + a AS node, count(*) AS n, {moments}, sum({_sumsq()}) AS ss FROM a{v}_{ITERS} GROUP BY ALL"),
            S.cte(f"rows{v + 1}", f"SELECT 2 * p.node + {_side('c')} AS node, {xs} FROM open{v} p JOIN c{v}_{ITERS} c USING (node)"),
            S.cte(f"leaves{v + 1}", f"SELECT (SELECT leaves FROM leaves{v}) + (SELECT count(*) FROM chosen{v}) AS leaves")]
    ctes.append(S.cte("every", " UNION ALL ".join(f"SELECT node, n, {ms}, ss FROM made{v}" for v in range(DEEP_LEVELS + 1))))
    return ctes


def _deep_sql():
    dist = " + ".join(f"(a.m{i} - c.m{i}) * (a.m{i} - c.m{i})" for i in range(D))
    # A raw index is a 1 and the turns as bits: shifted to one length it orders the tree left first.
    low = f"node << ({DEEP_LEVELS} - CAST(floor(log2(node)) AS BIGINT))"
    ctes = _deep_ctes() + [
        S.cte("inside", f"SELECT a.node, sqrt(max({dist})) AS height FROM every a JOIN every c ON c.node // 2 = a.node GROUP BY a.node"),
        S.cte("marked", f"SELECT e.*, height, height IS NULL AS is_leaf, {low} AS low FROM every e LEFT JOIN inside USING (node)"),
        S.cte("placed", "SELECT *, count(*) FILTER (is_leaf) OVER w AS n_leaf, count(*) FILTER (NOT is_leaf) OVER w AS n_inside "
                        "FROM marked WINDOW w AS (ORDER BY low, node ROWS UNBOUNDED PRECEDING)")]
    return S.with_(ctes, "\nUNION ALL\n".join(
        f"SELECT node AS raw_index, CAST(CASE WHEN is_leaf THEN n_leaf - 1 ELSE -n_inside END AS INTEGER) AS node_index, "
        f"CASE WHEN node > 1 THEN node // 2 END AS parent_raw, n AS size, CAST(round({_cost()}, 2) AS DOUBLE) AS cost, "
        f"CAST(round(coalesce(height, 0.0), 6) AS DOUBLE) AS height, is_leaf, CAST({i} AS INTEGER) AS dim, "
        f"CAST(round(m{i}, {TREE_DIGITS}) AS DOUBLE) AS value FROM placed" for i in range(D)))


def _deep_model(spark, sf_dir):
    return B.train(X.points_li(spark, sf_dir), k=DEEP_K, max_iter=ITERS, noise=np.array(NOISE))


@query("bisecting_train_given", _deep_sql)
def bisecting_train_given(spark, sf_dir):
    """D1 with k = 6 and given noise: three levels, of which the last divides
    the two largest of four nodes."""
    return _tree_out(_deep_model(spark, sf_dir), spark)


def _levels_sql():
    return S.with_(_deep_ctes(), " UNION ALL ".join(
        f"SELECT CAST({v + 1} AS INTEGER) AS level, (SELECT count(*) FROM chosen{v}) AS divided, "
        f"(SELECT count(*) FROM open{v}) AS rows" for v in range(DEEP_LEVELS)))


@query("bisecting_levels", _levels_sql)
def bisecting_levels(spark, sf_dir):
    """The nodes that each level divides and the rows that its passes read."""
    return _deep_model(spark, sf_dir).levels_df(spark).drop("passes")
