"""Registered queries over sparse points (A1, B3-B5, C8, C9) and their oracles.

Points are the documents' bags of words over the whole vocabulary, divided by
their norms.  Start centres are the means of doc_id % 4.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sparse import CenterTable
from ..session import cut_lineage
from ..operators import sparse
from ..sources import sparse as P
from . import sqlgen as S
from .lda_queries import _corpus, document_bags, term_counts
from .registry import query

K, M, STEPS, FUZZY_STEPS = 4, 2.0, 3, 2


def points(spark, sf_dir):
    return P.unit_length(P.from_bags(document_bags(spark, sf_dir)[0]))


def started(spark, sf_dir):
    pts = points(spark, sf_dir)
    table, k = sparse.group_means(pts, F.pmod("id", F.lit(K)))
    assert k == K
    return pts, table


def _start():
    return [*_corpus(),
            S.cte("norms", "SELECT doc_id, sqrt(sum(cnt * cnt)) AS norm FROM tok GROUP BY doc_id"),
            S.cte("x", "SELECT doc_id, term_id, cnt / norm AS v FROM tok JOIN norms USING (doc_id)"),
            S.cte("c0", f"SELECT CAST(doc_id % {K} AS INTEGER) AS cluster, term_id, sum(v) / any_value(n) AS v FROM x JOIN "
                        f"(SELECT doc_id % {K} AS g, count(*) AS n FROM norms GROUP BY 1) ON g = doc_id % {K} GROUP BY 1, 2")]


def _dist(c: str, s: str):
    """Squared distances of every document to every centre of table ``c``."""
    return [S.cte(f"d{s}", f"""SELECT n.doc_id, k.cluster, greatest(1.0 - 2 * coalesce(dot, 0) + sq, 0) AS d FROM norms n CROSS JOIN
  (SELECT cluster, sum(v * v) AS sq FROM {c} GROUP BY cluster) k LEFT JOIN
  (SELECT doc_id, cluster, sum(x.v * c.v) AS dot FROM x JOIN {c} c USING (term_id) GROUP BY ALL) t ON t.doc_id = n.doc_id AND t.cluster = k.cluster""")]


def _hard(c: str, s: str):
    return [*_dist(c, s), S.cte(f"a{s}", f"SELECT doc_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM d{s} GROUP BY doc_id")]


def _kmeans_sql():
    ctes = _start()
    for s in range(STEPS):
        ctes += _hard(f"c{s}", str(s))
        ctes.append(S.cte(f"c{s + 1}", f"SELECT cluster, term_id, sum(v) / any_value(n) AS v FROM x JOIN a{s} USING (doc_id) "
                                       f"JOIN (SELECT cluster, count(*) AS n FROM a{s} GROUP BY 1) USING (cluster) GROUP BY 1, 2 "
                                       f"UNION ALL SELECT * FROM c{s} WHERE cluster NOT IN (SELECT cluster FROM a{s})"))
    return S.with_(ctes, f"SELECT cluster, term_id, CAST(round(v, 8) AS DOUBLE) AS value FROM c{STEPS}")


def _u(c: str, s: str):
    return [*_dist(c, s),
            S.cte(f"u{s}", f"SELECT doc_id, cluster, d, CASE WHEN least_d <= 0 THEN (CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END) / zeros "
                           f"ELSE (least_d / d) / ratios END AS u FROM (SELECT *, min(d) OVER w AS least_d, "
                           f"count(*) FILTER (d <= 0) OVER w AS zeros, sum(1.0 / nullif(d, 0)) OVER w * min(d) OVER w AS ratios "
                           f"FROM d{s} WINDOW w AS (PARTITION BY doc_id))")]


def _fuzzy_sql():
    ctes = _start()
    for s in range(FUZZY_STEPS):
        ctes += _u(f"c{s}", str(s))
        ctes.append(S.cte(f"c{s + 1}", f"SELECT cluster, term_id, sum(u * u * v) / any_value(w) AS v FROM x JOIN u{s} USING (doc_id) "
                                       f"JOIN (SELECT cluster, sum(u * u) AS w FROM u{s} GROUP BY 1) USING (cluster) GROUP BY 1, 2"))
    return S.with_(ctes, f"SELECT cluster, term_id, CAST(round(v, 8) AS DOUBLE) AS value FROM c{FUZZY_STEPS}")


def _table(model, spark):
    return model.centers_df(spark).select("cluster", F.col("index").alias("term_id"), F.round("value", 8).alias("value"))


@query("sparse_points_norms", lambda: S.with_(
    _corpus(), "SELECT doc_id, count(*) AS nonzeros, CAST(round(sqrt(sum(cnt * cnt)), 6) AS DOUBLE) AS norm FROM tok GROUP BY doc_id"))
def sparse_points_norms(spark, sf_dir):
    """A1: non-zeros and norms of all documents' bags of words."""
    pts = P.from_entries(term_counts(spark, sf_dir), "doc_id", "term_id", "cnt")
    return pts.select(F.col("id").alias("doc_id"), F.size(P.INDICES).cast("long").alias("nonzeros"), F.round(P.norm_expr(), 6).alias("norm"))


@query("sparse_kmeans_assign", lambda: S.with_(
    _start() + _hard("c0", "0"), "SELECT doc_id, cluster, CAST(round(d, 6) AS DOUBLE) AS dist2 FROM a0"))
def sparse_kmeans_assign(spark, sf_dir):
    """C8 over sparse points."""
    pts, table = started(spark, sf_dir)
    near = sparse.assign(pts, CenterTable(K, cut_lineage(table)))
    return near.select(F.col("id").alias("doc_id"), "cluster", F.round("dist2", 6).alias("dist2"))


@query("sparse_kmeans_train", _kmeans_sql)
def sparse_kmeans_train(spark, sf_dir):
    """C1/C9 over sparse points: three passes."""
    pts, table = started(spark, sf_dir)
    return _table(sparse.train_kmeans(pts, K, init=table, max_iter=STEPS, epsilon=0.0), spark)


@query("sparse_fcm_membership", lambda: S.with_(
    _start() + _u("c0", "0"), "SELECT doc_id, cluster, CAST(round(u, 6) AS DOUBLE) AS u FROM u0"))
def sparse_fcm_membership(spark, sf_dir):
    """B5 over sparse points."""
    pts, table = started(spark, sf_dir)
    u = sparse.memberships(pts, CenterTable(K, cut_lineage(table)), M)
    return u.select(F.col("id").alias("doc_id"), F.posexplode("u").alias("cluster", "u")).withColumn("u", F.round("u", 6))


@query("sparse_fcm_train", _fuzzy_sql)
def sparse_fcm_train(spark, sf_dir):
    """B1/B3 over sparse points: two passes."""
    pts, table = started(spark, sf_dir)
    return _table(sparse.train_fuzzy(pts, K, M, init=table, max_iter=FUZZY_STEPS, epsilon=0.0), spark)
