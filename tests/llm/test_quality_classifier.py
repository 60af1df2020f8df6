"""Quality classifier: held-out accuracy, and its edge cases."""

import numpy as np
import pytest

from softcluster.llm import quality_classifier as Q

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels


def test_held_out_accuracy(tables):
    docs, labels = tables
    fitted, held = labels.where("pmod(xxhash64(doc_id), 4) > 0"), labels.where("pmod(xxhash64(doc_id), 4) = 0")
    got = {r.doc_id: r.kept for r in Q.quality_classifier(docs, fitted).collect()}
    assert len(got) == docs.count()
    rows = held.collect()
    share = lambda rule: np.mean([got[r.doc_id] for r in rows if rule(r)])
    assert share(lambda r: r.quality == 1 and r.toxic == 0) > 0.97
    assert share(lambda r: r.quality == 0) < 0.05
    assert share(lambda r: r.quality == 1 and r.toxic == 1) < 0.15


def test_views_teach_each_other():
    """The page view has no labelled row of half its columns; the text view's labels reach it."""
    rng = np.random.default_rng(0)
    n = 1500
    y = rng.integers(0, 2, n).astype(float)
    pool = np.arange(n) >= 300
    # Text: a sure sign. Page: a column that tells the label, of 20 of which the labelled rows show two.
    text = Q.Rows(np.arange(n + 1), y.astype(int), np.full(n, 10.0), 2)
    site = np.where(pool, rng.integers(2, 20, n), rng.integers(0, 2, n))
    page = Q.Rows(np.arange(n + 1), (site * 2 + y).astype(int), np.ones(n), 40)
    known = np.where(pool, np.nan, y)
    held = ~pool & (np.arange(n) % 3 == 0)
    right = {}
    for rounds in (0, 3):
        model = Q.co_train(text, page, known, np.ones(n), held, rounds=rounds)
        p = Q._sigmoid((page.dot(model.page[:-1]) + model.page[-1]) * model.page_cal[0] + model.page_cal[1])
        right[rounds] = np.mean((p > 0.5)[pool] == y[pool])
    assert right[0] < 0.7 and right[3] > 0.9


def test_edge_rows(spark, tables):
    docs, labels = tables
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "the and of " * 50000, None, "s", -3)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumnRenamed("x", "score")
    odd = odd.selectExpr("*", "1 as score", "2 as k0")
    model = Q.train(docs, labels.unionAll(labels.limit(0)), labelled=300, pool=100, rounds=1)
    out = Q.classify(odd, model, tuple(odd.columns)).collect()
    assert sorted((r[0] is None, r[0] or 0) for r in out) == [(False, 1), (False, 2), (False, 2), (True, 0)]
    assert all(0 <= r[-2] <= 1 for r in out)
    # Too few labels: nothing is judged, nothing goes.
    none = Q.quality_classifier(odd, labels.limit(0))
    assert none.count() == 4 and none.where("kept and score is null").count() == 4
    kept = Q.keep_good(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == 4
    assert Q.quality_classifier(odd.where("false"), labels).collect() == []
