"""Registered power-iteration-clustering queries (section F) and oracles.

Affinity graph: suppliers and parts of ``lineitem``, weight = number of
lineitems linking them (part ids offset by 1e9).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import draws
from ..operators import pic
from ..sources import edges as E
from . import fixtures as X
from . import sqlgen as S
from .registry import query

STEPS = 5
EPS = pic.EPSILON


def supp_edges(spark, sf_dir):
    return E.supplier_part_edges(X.table(spark, sf_dir, "lineitem"))


def _base():
    return [
        S.cte("e", f"SELECT CAST(l_suppkey AS BIGINT) AS src, "
                   f"CAST(l_partkey + {E.PART_OFFSET} AS BIGINT) AS dst, "
                   f"CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2"),
        S.cte("a", "SELECT src, dst, weight FROM e WHERE src <> dst UNION ALL "
                   "SELECT dst AS src, src AS dst, weight FROM e WHERE src <> dst"),
        S.cte("rs", "SELECT src, sum(weight) AS rowsum FROM a GROUP BY src"),
        S.cte("w", f"SELECT a.src, a.dst, a.weight / greatest(rs.rowsum, {EPS!r}) AS weight "
                   f"FROM a JOIN rs USING (src)"),
        S.cte("v0", "SELECT src AS id, rowsum / (SELECT sum(rowsum) FROM rs) AS v FROM rs"),
    ]


def _v_out(df):
    return df.select("id", F.round("v", 12).alias("v"))


@query("pic_edges", lambda: S.with_(_base(), "SELECT src, dst, weight FROM e"))
def pic_edges(spark, sf_dir):
    """A3: checked affinity edge source."""
    return supp_edges(spark, sf_dir)


@query("pic_normalize", lambda: S.with_(
    _base(), "SELECT src, dst, CAST(round(weight, 12) AS DOUBLE) AS weight FROM w"))
def pic_normalize(spark, sf_dir):
    """mirror, drop self pairs, row-normalise."""
    w = pic.normalize(supp_edges(spark, sf_dir))
    return w.select("src", "dst", F.round("weight", 12).alias("weight"))


@query("pic_normalize_directed", lambda: S.with_(
    _base(), "SELECT src, dst, CAST(round(weight, 12) AS DOUBLE) AS weight FROM w"))
def pic_normalize_directed(spark, sf_dir):
    """the same graph given as a symmetric directed table."""
    e = supp_edges(spark, sf_dir)
    directed = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"),
                                      "weight"))
    w = pic.normalize_directed(directed)
    return w.select("src", "dst", F.round("weight", 12).alias("weight"))


@query("pic_init_degree", lambda: S.with_(
    _base(), "SELECT id, CAST(round(v, 12) AS DOUBLE) AS v FROM v0"))
def pic_init_degree(spark, sf_dir):
    """degree start vector."""
    return _v_out(pic.init_degree(pic._mirrored(supp_edges(spark, sf_dir))))


def _power_ctes():
    ctes = _base()
    for t in range(1, STEPS + 1):
        ctes.append(S.cte(f"r{t}", f"SELECT w.src AS id, sum(w.weight * v.v) AS v FROM w "
                                   f"JOIN v{t - 1} v ON w.dst = v.id GROUP BY w.src"))
        ctes.append(S.cte(f"v{t}", f"SELECT id, v / (SELECT sum(abs(v)) FROM r{t}) AS v "
                                   f"FROM r{t}"))
    return ctes


@query("pic_power_iter", lambda: S.with_(
    _power_ctes(), f"SELECT id, CAST(round(v, 12) AS DOUBLE) AS v FROM v{STEPS}"))
def pic_power_iter(spark, sf_dir):
    """5 power steps from the degree vector."""
    w, deg = pic.normalize(supp_edges(spark, sf_dir), with_degrees=True)
    res = pic.power_iteration(w, pic.init_degree(degrees_df=deg), max_iter=STEPS,
                              fixed_steps=True)
    return _v_out(res.v)


@query("pic_init_random", lambda: S.with_(
    [*_base(), S.cte("g", f"SELECT id, {draws.normal_sql(3, 'id')} AS r FROM v0")],
    "SELECT id, CAST(round(r / (SELECT sum(abs(r)) FROM g), 12) AS DOUBLE) AS v FROM g"))
def pic_init_random(spark, sf_dir):
    """gaussian start / L1 norm, drawn by vertex."""
    w = pic.normalize(supp_edges(spark, sf_dir))
    return _v_out(pic.init_random(w, seed=3))


# K-means from the embedding's least and largest value, six passes at most

PASSES = 6


def _starts(v):
    lo, hi = v.agg(F.min("v"), F.max("v")).first()
    return np.array([[lo], [hi]])


def _labels(w, deg):
    res = pic.power_iteration(w, pic.init_degree(degrees_df=deg), max_iter=STEPS, fixed_steps=True)
    return pic.assign(res.v, 2, starts=_starts(res.v), max_iter=PASSES)


def _assign_sql():
    ctes = _power_ctes()
    ctes.append(S.cte("k0", f"SELECT min(v) AS a, max(v) AS b FROM v{STEPS}"))
    side = "(v - b) * (v - b) < (v - a) * (v - a)"
    for t in range(1, PASSES + 1):
        ctes.append(S.cte(f"k{t}", f"SELECT coalesce(avg(v) FILTER (NOT ({side})), any_value(a)) AS a, "
                                   f"coalesce(avg(v) FILTER ({side}), any_value(b)) AS b FROM v{STEPS}, k{t - 1}"))
    return S.with_(ctes, f"SELECT id, CAST(({side}) AS INTEGER) AS cluster FROM v{STEPS}, k{PASSES}")


@query("pic_assign", _assign_sql)
def pic_assign(spark, sf_dir):
    """k-means on the embedding after 5 steps, given starts."""
    return _labels(*pic.normalize(supp_edges(spark, sf_dir), with_degrees=True))


def _directed(spark, sf_dir):
    e = supp_edges(spark, sf_dir)
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


@query("pic_graph_run", _assign_sql)
def pic_graph_run(spark, sf_dir):
    """A4: the same graph given as a symmetric directed table: edges to labels."""
    return _labels(*pic.normalize_directed(_directed(spark, sf_dir), with_degrees=True))


@query("pic_run", _assign_sql)
def pic_run(spark, sf_dir):
    """edges to labels by ``run`` itself: degree start, 5 steps, given starts."""
    return pic.run(supp_edges(spark, sf_dir), k=2, max_iter=STEPS, init="degree", fixed_steps=True,
                   starts=_starts, kmeans_iter=PASSES)


@query("pic_run_random")
def pic_run_random(spark, sf_dir):
    """whole run, k = 2, up to 100 steps, random start (rows-only)."""
    return pic.run(supp_edges(spark, sf_dir), k=2, max_iter=100, init="random", seed=1)


@query("pic_assignments_roundtrip", _assign_sql)
def pic_assignments_roundtrip(spark, sf_dir):
    """(id, cluster) assignments saved and loaded."""
    from ..sources import store
    assign = _labels(*pic.normalize(supp_edges(spark, sf_dir), with_degrees=True))
    path = store.save_assignments(assign, 2)
    return store.load_assignments(spark, path)


# F5 with hot destinations: orders as edges between customers and five priorities

HUB_CELL = 256


def _hub_sql():
    ctes = _power_ctes()
    ctes[0] = S.cte("e", "SELECT CAST(o_custkey AS BIGINT) AS src, CAST(-ascii(o_orderpriority) AS BIGINT) AS dst, "
                         "CAST(count(*) AS DOUBLE) AS weight FROM orders GROUP BY 1, 2")
    return S.with_(ctes, f"SELECT id, CAST(round(v, 12) AS DOUBLE) AS v FROM v{STEPS}")


@query("pic_power_iter_hubs", _hub_sql)
def pic_power_iter_hubs(spark, sf_dir):
    """F5 on a graph whose five hubs hold all edges, each spread over many cells."""
    orders = X.table(spark, sf_dir, "orders").where("o_custkey is not null and o_orderpriority is not null")
    edges = orders.groupBy(F.col("o_custkey").cast("long").alias("src"), (-F.ascii("o_orderpriority")).cast("long").alias("dst")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"))
    w, deg = pic.normalize(edges, with_degrees=True)
    res = pic.power_iteration(w, pic.init_degree(degrees_df=deg), max_iter=STEPS, fixed_steps=True, least_cell=HUB_CELL)
    return _v_out(res.v)
