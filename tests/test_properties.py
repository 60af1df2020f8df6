"""Layer 2: properties and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from softcluster.functions import centers as C
from softcluster.functions.kernels import fuzzy_u
from softcluster.functions.special import digamma, lgamma, trigamma
from softcluster.operators import bisecting as B
from softcluster.operators import fuzzy, kmeans, mixture, pic
from softcluster.operators import topics as TP
from softcluster.plans import fixtures as X
from softcluster.plans import fuzzy_queries as FQ
from softcluster.sources import points as P


def pts_df(spark, rows, with_id=True):
    data = [(i, [float(v) for v in r]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, features array<double>")
    return df if with_id else df.select("features")


# --- fuzzy c-means -----------------------------------------------------------

def test_memberships_sum_to_one(spark, sf_dir):
    pts, start = FQ.li_start(spark, sf_dir)
    wide = fuzzy.membership(pts, start, 2.0, long=False)
    bad = wide.where(F.abs(F.aggregate("u", F.lit(0.0), lambda a, x: a + x) - 1.0) > 1e-9)
    assert bad.count() == 0


def test_fuzzy_objective_never_rises(spark, sf_dir):
    pts, start = FQ.li_start(spark, sf_dir)
    model = fuzzy.train(pts, k=4, m=2.0, max_iter=6, epsilon=0.0, init=start)
    vals = [t["value"] for t in model.trace]
    assert all(b <= a * (1 + 1e-12) for a, b in zip(vals, vals[1:]))


def test_row_on_a_centre_q5():
    d = np.array([[0.0, 4.0, 0.0], [1.0, 1.0, 4.0]])
    u = fuzzy_u(d, 2.0)
    assert np.allclose(u[0], [0.5, 0.0, 0.5])
    assert np.allclose(u.sum(axis=1), 1.0)


def test_m_must_exceed_one(spark):
    df = pts_df(spark, [[0, 0], [1, 1], [2, 2]])
    for m in (1.0, 0.5):
        with pytest.raises(ValueError):
            fuzzy.train(df, k=2, m=m, init=np.array([[0.0, 0.0], [2.0, 2.0]]))


def test_result_independent_of_partitioning(spark, sf_dir):
    pts, start = FQ.li_start(spark, sf_dir)
    base = fuzzy.step_sums(pts, start, 2.0)
    for n in (1, 3, 16):
        other = fuzzy.step_sums(pts.repartition(n), start, 2.0)
        assert np.allclose(base, other, rtol=1e-12, atol=1e-9)


def test_membership_delta_zero_for_same(spark, sf_dir):
    pts = X.points_ev(spark, sf_dir)
    c = np.array([[0.5, 0.2], [2.0, 0.7]])
    a = fuzzy.membership(pts, c, 2.0, keep=["event_id"])
    assert fuzzy.membership_delta(a, a, keys=("event_id",)).first()[0] == 0.0


def test_init_membership_rows_sum_to_one(spark, sf_dir):
    pts = X.points_ev(spark, sf_dir)
    u = fuzzy.init_membership(pts, 3, seed=1, id_col="event_id")
    s = u.groupBy("event_id").agg(F.sum("u").alias("s"))
    assert s.where(F.abs(F.col("s") - 1.0) > 1e-9).count() == 0
    assert u.count() == 3 * pts.count()


# --- k-means ---------------------------------------------------------------------

def test_lloyd_cost_never_rises(spark, sf_dir):
    pts, start = FQ.li_start(spark, sf_dir)
    model = kmeans.train(pts, k=4, max_iter=6, epsilon=0.0, init=start)
    vals = [t["value"] for t in model.trace]
    assert all(b <= a * (1 + 1e-12) for a, b in zip(vals, vals[1:]))


def test_cluster_counts_sum_to_rows(spark, sf_dir):
    pts, start = FQ.li_start(spark, sf_dir)
    steps = kmeans.step_table(pts, start)
    assert steps.agg(F.sum("count")).first()[0] == pts.count()


def test_unknown_init_mode_raises(spark):
    df = pts_df(spark, [[0, 0], [1, 1]])
    with pytest.raises(ValueError):
        kmeans.train(df, k=2, init="bogus")


def test_k_larger_than_distinct_rows(spark):
    df = pts_df(spark, [[1, 1]] * 5 + [[2, 2]] * 5)
    cs = kmeans.init_parallel(df, 4, seed=1)
    assert len(cs) == 2  # Q10: fewer centres, never repeated rows


def test_all_rows_equal(spark):
    df = pts_df(spark, [[3.0, 3.0]] * 10)
    m = kmeans.train(df, k=1, init="random")
    assert np.allclose(m.centers, [[3.0, 3.0]]) and m.compute_cost(df) == 0.0


def test_null_and_unequal_rows(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([1.0, None],)], "features array<double>")
    st = P.validate(df)
    assert st.rows == 1 and st.dropped == 2 and st.dim == 2
    bad = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "features array<double>")
    with pytest.raises(ValueError):
        P.validate(bad)


def test_agrees_with_builtin_rdd_kmeans(spark, sf_dir):
    from pyspark.mllib.clustering import KMeans as RDDKMeans, KMeansModel as RDDModel
    pts, start = FQ.li_start(spark, sf_dir)
    ours = kmeans.train(pts, k=4, max_iter=5, epsilon=0.0, init=start)
    rdd = pts.select("features").rdd.map(lambda r: list(r[0]))
    theirs = RDDKMeans.train(rdd, 4, maxIterations=5, initialModel=RDDModel(list(start)),
                             epsilon=0.0)
    got = np.array(sorted(map(tuple, ours.centers)))
    exp = np.array(sorted(tuple(c) for c in theirs.clusterCenters))
    assert np.allclose(got, exp, rtol=1e-9)


# --- bisecting -------------------------------------------------------------------

def test_bisecting_leaves_partition_rows(spark, sf_dir):
    pts = X.points_li(spark, sf_dir)
    model = B.train(pts, k=4, seed=3)
    tree = model.tree_df(spark)
    leaves = tree.where("is_leaf").agg(F.sum("size")).first()[0]
    assert leaves == pts.count()
    assert tree.count() == 2 * model.k - 1
    pred = model.predict(pts, keep=[])
    assert pred.select("prediction").distinct().count() <= model.k


def test_bisecting_constant_rows_not_divisible(spark):
    df = pts_df(spark, [[1.0, 1.0]] * 6)
    model = B.train(df, k=3)
    assert model.k == 1


# --- mixture -------------------------------------------------------------------------

def test_llh_never_falls(spark, sf_dir):
    from softcluster.plans import gmm_queries as GQ
    pts, mix = GQ.start(spark, sf_dir)
    fit = mixture.train(pts, k=2, max_iter=5, tol=-1.0, init=mix)
    ll = [t["llh"] for t in fit.trace]
    assert all(b >= a - 1e-9 * abs(a) for a, b in zip(ll, ll[1:]))


def test_singular_covariance_has_density(spark):
    df = pts_df(spark, [[float(i), 5.0] for i in range(20)])
    mix = mixture.Mixture(np.array([0.5, 0.5]), np.array([[3.0, 5.0], [15.0, 5.0]]),
                          np.array([np.diag([4.0, 0.0]), np.diag([4.0, 0.0])]))
    new, llh = mixture.em_step(df, mix)
    assert np.isfinite(llh) and np.all(np.isfinite(new.mus))


# --- PIC ---------------------------------------------------------------------------

def test_pic_rows_sum_to_one(spark, sf_dir):
    from softcluster.plans import pic_queries as PQ
    w = pic.normalize(PQ.supp_edges(spark, sf_dir))
    s = w.groupBy("src").agg(F.sum("weight").alias("s"))
    assert s.where(F.abs(F.col("s") - 1.0) > 1e-12).count() == 0


def test_pic_negative_weight_raises(spark):
    e = spark.createDataFrame([(1, 2, -1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    with pytest.raises(Exception):
        pic.normalize(e).collect()


def test_pic_self_and_duplicate_edges(spark):
    e = spark.createDataFrame([(1, 1, 5.0), (1, 2, 1.0), (1, 2, 1.0), (2, 3, 2.0)],
                              "src long, dst long, weight double")
    w = {}
    for r in pic.normalize(e).collect():  # duplicate edges stay; their weights add up
        w[(r[0], r[1])] = w.get((r[0], r[1]), 0.0) + r[2]
    assert (1, 1) not in w and w[(1, 2)] == pytest.approx(1.0)
    assert w[(2, 1)] == pytest.approx(0.5) and w[(2, 3)] == pytest.approx(0.5)


# --- streaming ----------------------------------------------------------------------

def test_replayed_batch_changes_nothing(spark, sf_dir):
    from softcluster.plans import stream_queries as SQ
    from softcluster.streaming.kmeans import StreamingKMeans
    feed, start = SQ.start_centers(spark, sf_dir)
    m = StreamingKMeans(k=4, decay=0.5).set_initial_centers(spark, start, 1.0)
    b0 = feed.where("blk = 0")
    m.update(b0, 0)
    first = m.latest_centers(spark)
    m.update(b0, 0)  # replay of batch 0
    assert np.array_equal(first, m.latest_centers(spark))


def test_empty_micro_batch(spark, sf_dir):
    from softcluster.plans import stream_queries as SQ
    from softcluster.streaming.kmeans import StreamingKMeans
    feed, start = SQ.start_centers(spark, sf_dir)
    m = StreamingKMeans(k=4, decay=1.0).set_initial_centers(spark, start, 1.0)
    m.update(feed.where("false"), 0)
    assert np.allclose(m.latest_centers(spark), start)


def test_dying_cluster_split():
    from softcluster.streaming.kmeans import apply_update
    c = np.array([[0.0, 0.0], [10.0, 10.0]])
    c2, w2, split = apply_update(c, np.array([5.0, 0.0]), np.zeros((2, 2)), np.zeros(2),
                                 1.0, "batches")
    assert split and w2[0] == w2[1] == 2.5
    assert np.allclose(c2[0], c2[1]) and not np.array_equal(c2[0], c2[1])


# --- topics --------------------------------------------------------------------------------

def test_em_conserves_tokens(spark, sf_dir):
    from softcluster.plans import lda_queries as LQ
    tc = LQ.term_counts(spark, sf_dir)
    total = tc.agg(F.sum("cnt")).first()[0]
    m = TP.train_em(tc, k=3, max_iter=2, init="hash")
    doc_total = m.doc_topics.agg(sum(F.sum(c) for c in TP.ncols(3))).first()[0]
    assert doc_total == pytest.approx(total, rel=1e-12)
    assert m.n_k.sum() == pytest.approx(total, rel=1e-12)


def test_em_priors_checked():
    with pytest.raises(ValueError):
        TP.em_priors(3, alpha=0.5)
    assert TP.em_priors(10) == (6.0, 1.1)


def test_special_functions():
    assert digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-13)
    assert trigamma(np.array([1.0]))[0] == pytest.approx(math.pi ** 2 / 6, abs=1e-12)
    assert lgamma(np.array([0.5]))[0] == pytest.approx(math.log(math.sqrt(math.pi)))


def test_online_transform_empty_doc_gets_zeros(spark, sf_dir):
    from softcluster.operators import topics_online as OL
    a, e = OL.online_priors(3)
    lam = OL.init_lambda(spark, 3, 10, seed=1)
    model = OL.OnlineLDAModel(lam, 3, 10, a, e)
    docs = spark.createDataFrame([(1, [], []), (2, [0, 3], [2.0, 1.0])],
                                 "doc_id long, terms array<int>, counts array<double>")
    out = {r[0]: r[1] for r in model.transform(docs).collect()}
    assert out[1] == [0.0, 0.0, 0.0] and sum(out[2]) == pytest.approx(1.0)


def test_centres_table_roundtrip(spark):
    c = np.array([[1.0, 2.0], [3.0, 4.0]])
    assert np.array_equal(C.from_df(C.to_df(spark, c)), c)


def test_em_plan_and_lineage_do_not_grow(spark, sf_dir):
    from softcluster.plans import lda_queries as LQ
    tc = LQ.term_counts(spark, sf_dir).persist()
    size = [len(TP.train_em(tc, k=2, max_iter=n, init="random", seed=1).doc_topics
                ._jdf.queryExecution().logical().toString()) for n in (1, 4)]
    assert abs(size[0] - size[1]) < 100 and size[1] < 2000


def test_all_terms_ranked_without_a_window_over_all(spark, sf_dir):
    from softcluster.plans import lda_queries as LQ
    m = LQ.em_model(spark, sf_dir, 1)
    every, top = m.describe_topics(), m.describe_topics(7)
    assert every.count() == 3 * m.vocab_size
    key = lambda df: sorted(map(tuple, df.select("topic", "rank", "term_id").collect()))
    assert key(every.where("rank <= 7")) == key(top)


def test_inference_of_many_documents_is_that_of_each():
    from softcluster.operators import topics_online as OL
    rng = np.random.default_rng(1)
    sizes = np.array([1, 40, 3, 200])
    el = np.log(rng.dirichlet(np.ones(5), sizes.sum()))
    counts, alpha = rng.integers(1, 6, sizes.sum()).astype(float), np.full(5, 0.2)
    how = OL.Inference(seed=3)
    all_ = OL.Batch(np.arange(4), sizes, np.arange(sizes.sum()), counts, el).infer(alpha, how)
    ends = np.cumsum(sizes)
    for i in range(4):
        part = slice(ends[i] - sizes[i], ends[i])
        one = OL.Batch(np.array([i]), sizes[i:i + 1], np.arange(sizes[i]), counts[part], el[part]).infer(alpha, how)
        assert np.allclose(one[0], all_[i], rtol=1e-12)


def test_newton_step_climbs(spark):
    from softcluster.operators import topics_online as OL
    from softcluster.functions.special import dirichlet_expectation
    rng = np.random.default_rng(2)
    true = np.array([0.5, 2.0, 4.0])
    mean = np.log(rng.dirichlet(true, 20000)).mean(axis=0)
    a = np.full(3, 1.0)
    for _ in range(60):
        a = OL.update_alpha(a, mean, 0.5)
    assert np.allclose(a, true, rtol=0.05) and np.allclose(dirichlet_expectation(a), mean, atol=1e-6)
    assert np.array_equal(OL.update_alpha(np.full(3, 0.01), np.array([-900.0, -0.1, -0.1]), 1.0), np.full(3, 0.01))


def test_stream_state_retention(spark, sf_dir):
    from softcluster.plans import stream_queries as SQ
    from softcluster.streaming.kmeans import StreamingKMeans
    feed, start = SQ.start_centers(spark, sf_dir)
    m = StreamingKMeans(k=4, decay=1.0, keep_states=2).set_initial_centers(spark, start, 1.0)
    SQ.run_static(m, feed)
    left = {r[0] for r in spark.read.parquet(m.state_dir).select("batch_id").distinct().collect()}
    assert left == {1, 2}


def test_replayed_batch_is_scored_with_its_own_centres(spark, sf_dir):
    from softcluster.plans import stream_queries as SQ
    from softcluster.sources.stream import write_feed
    from softcluster.streaming.kmeans import StreamingKMeans
    feed, start = SQ.start_centers(spark, sf_dir)
    m = StreamingKMeans(k=4).set_initial_centers(spark, start, 1.0)
    blocks = write_feed(feed.select("event_id", P.FEATURES, "blk"), "blk")

    def scored(checkpoint):
        out = m.state_dir + "-scored"
        m.predict_on(blocks, out, keep=["event_id"], checkpoint=out + checkpoint).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).select("event_id", "prediction", "batch_id").collect()))

    first = scored("-a")
    assert len(first) == feed.count() and {r[2] for r in first} == {0, 1, 2}
    m.set_initial_centers(spark, start[::-1].copy(), 1.0)  # other states come meanwhile
    assert scored("-b") == first


def test_gmm_default_start(spark, sf_dir):
    pts = X.points_li2(spark, sf_dir)
    fit = mixture.train(pts, k=2, max_iter=3, seed=4)
    assert np.isclose(fit.weights.sum(), 1.0) and len(fit.trace) >= 1
    assert np.all(np.isfinite(fit.mus))


def test_pic_separates_two_cliques(spark):
    edges = []
    for base in (0, 10):
        for i in range(base, base + 5):
            for j in range(i + 1, base + 5):
                edges.append((i, j, 1.0))
    edges.append((0, 10, 0.01))  # one weak bridge
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    # a random start: with equal degrees the degree vector is already the
    # walk's fixed point (constant), which carries no cluster signal
    labels = {r["id"]: r["cluster"]
              for r in pic.run(e, k=2, max_iter=50, init="random", seed=3).collect()}
    a = {labels[i] for i in range(0, 5)}
    b = {labels[i] for i in range(10, 15)}
    assert len(a) == 1 and len(b) == 1 and a != b


def test_gmm_recovers_separated_blobs(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal([0, 0], 0.5, (200, 2)), rng.normal([10, 10], 0.5, (200, 2))])
    df = pts_df(spark, x.tolist())
    # A start's slices may mix both blobs, which EM cannot part: the best of some starts.
    fit = max((mixture.train(df, k=2, max_iter=30, seed=seed) for seed in range(4)),
              key=lambda f: f.trace[-1]["llh"])
    mus = sorted(map(tuple, np.round(fit.mus)))
    assert mus == [(0.0, 0.0), (10.0, 10.0)]
    assert np.allclose(sorted(fit.weights), [0.5, 0.5], atol=0.02)
