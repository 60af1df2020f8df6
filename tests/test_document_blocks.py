"""Document bags, EM and sparse passes over blocks: traffic by (block, place), results as by rows."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from softcluster.functions.sparse import CenterTable
from softcluster.operators import blocks as BL
from softcluster.operators import sparse
from softcluster.operators import topics as TP
from softcluster.operators import topics_online as OL
from softcluster.sources import bags
from softcluster.sources import sparse as P

WORD = re.compile(r"[^\W\d_]+")


def documents(spark, n=120, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(int(d), " ".join(f"{'Wort' if x % 3 else 'äß'}{chr(97 + x % 26)}{chr(97 + x // 26)}" for x in rng.integers(0, 300, rng.integers(0, 80))))
            for d in range(n)]
    rows += [(3, "again Wortaa again"), (3, "again"), (5000, None), (5001, ""), (5002, "12 3 --"), (None, "lost words lost")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def slow_counts(rows):
    out = Counter()
    for d, t in rows:
        for w in WORD.findall(t or ""):
            out[d, w.lower()] += 1
    return out


def test_counts_and_vocabulary(spark, monkeypatch):
    rows, docs = documents(spark)
    want = slow_counts(rows)
    for size in (bags.BLOCK_BYTES, 300):
        monkeypatch.setattr(bags, "BLOCK_BYTES", size)
        monkeypatch.setattr(bags, "BATCH_ENTRIES", size)
        found, vocab = bags.document_bags(docs)
        words = {r.term_id: r.word for r in vocab.collect()}
        freq = Counter(w for _, w in want)
        assert [words[i] for i in range(len(words))] == sorted(freq, key=lambda w: (-freq[w], w))
        assert {r.word: r.doc_freq for r in vocab.collect()} == dict(freq)
        got = found.collect()
        assert len({r.doc_id for r in got}) == len(got) and all(list(r.terms) == sorted(set(r.terms)) for r in got)
        assert {(r.doc_id, words[t]): c for r in got for t, c in zip(r.terms, r.counts)} == dict(want)
    few, _ = bags.term_counts(docs, vocab_size=10)
    assert {r.term_id for r in few.collect()} == set(range(10))


def test_words_travel_once_per_block(spark):
    rows = [(i, "one two three " * 5) for i in range(400)]
    _, words = bags.coded_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert words.count() <= 3 * bags.NARROW and words.agg(F.sum("n")).first()[0] == 1200


def test_em_step_as_by_tokens(spark, monkeypatch):
    rows, docs = documents(spark)
    monkeypatch.setattr(BL, "BLOCK_ENTRIES", 100)
    monkeypatch.setattr(BL, "SLICE_VALUES", 50)
    k, alpha, eta = 3, 3.0, 1.1
    counts, vocab = bags.document_bags(docs)
    model = TP.train_em(counts, k=k, max_iter=2, init="hash", alpha=alpha, eta=eta)
    tokens = [(r.doc_id, r.term_id, r.cnt) for r in model.tokens.where("doc_id is not null").collect()]
    share = {(d, t): np.array([1 + (d * 31 + t * 17 + 7 * j) % 10 for j in range(k)], float) for d, t, _ in tokens}
    size = vocab.count()
    for step in range(3):
        doc, term = {}, {}
        for d, t, c in tokens:
            h = share[d, t] / share[d, t].sum() * c
            doc[d], term[t] = doc.get(d, 0) + h, term.get(t, 0) + h
        n_k = sum(term.values())
        if step < 2:
            share = {(d, t): (term[t] + eta - 1) * (doc[d] + alpha - 1) / (n_k + size * (eta - 1)) for d, t, _ in tokens}
    got = {r.doc_id: [r[c] for c in TP.ncols(k)] for r in model.doc_topics.collect()}
    assert got.keys() == doc.keys() and all(np.allclose(got[d], doc[d]) for d in doc)
    got = {r.term_id: [r[c] for c in TP.ncols(k)] for r in model.term_topics.collect()}
    assert got.keys() == term.keys() and all(np.allclose(got[t], term[t]) for t in term)
    # What a step fetches: a term once per block, however many documents of it have the term.
    fetched = model.dealt.fetch(model.term_topics, "term_id").count()
    pairs = {(r.block, t) for r in model.dealt.rows.collect() if r.doc_id is not None for t in r.terms}
    assert fetched == len(pairs) < len(tokens)


def test_sparse_centres_stay_a_table(spark, monkeypatch):
    """More centre values than the driver may hold: training and scoring go on."""
    monkeypatch.setattr("softcluster.functions.sparse.MAX_STATE_VALUES", 5)
    pts = spark.createDataFrame([(i, [i % 4, 10 + i], [1.0, 0.5]) for i in range(40)], "id long, indices array<int>, values array<double>")
    init = spark.createDataFrame([(j, j, 1.0) for j in range(4)], "cluster int, index int, value double")
    hard = sparse.train_kmeans(pts, 4, init=init, max_iter=2, epsilon=0.0)
    assert hard.centers_df(spark).count() == 44
    assert {(r.id % 4, r.prediction) for r in hard.predict(pts).collect()} == {(j, j) for j in range(4)}
    soft = sparse.train_fuzzy(pts, 4, 2.0, init=init, max_iter=1, epsilon=0.0)
    assert soft.centers_df(spark).count() == 4 * 44
    with pytest.raises(ValueError):
        soft.centers
    u = sparse.memberships(pts, CenterTable(4, init), 2.0).collect()
    assert all(np.isclose(sum(r.u), 1.0) for r in u)


def test_unit_length_computes_the_norm_once_a_row(spark):
    pts = spark.createDataFrame([(1, [0, 1], [3.0, 4.0]), (2, [], [])], "id long, indices array<int>, values array<double>")
    assert [list(r["values"]) for r in P.unit_length(pts).orderBy("id").collect()] == [[0.6, 0.8], []]
    wide = spark.range(1).selectExpr("id", "sequence(0, 199999) as indices", "transform(sequence(0, 199999), x -> 1.0D) as values")
    # A norm per value would take 4 * 10^10 steps.
    assert abs(P.unit_length(wide).first()["values"][7] - 200000 ** -0.5) < 1e-12


def test_a_task_holds_one_block(spark, monkeypatch):
    """Blocks by a hash of their number shared tasks, which then held the entries of several."""
    monkeypatch.setattr(BL, "BLOCK_ENTRIES", 60)
    pts = spark.createDataFrame([(i, [i % 7, 10 + i % 50, 100 + i], [1.0, 2.0, 0.5]) for i in range(400)],
                                "id long, indices array<int>, values array<double>")
    dealt = sparse.deal(pts)
    bags_ = pts.select(F.col("id").alias("doc_id"), F.col("indices").alias("terms"), F.col("values").alias("counts"))
    online, n = OL.blocks(bags_, 3, 180, counted=True)
    for rows, many in ((dealt.rows, dealt.n), (online, n)):
        held = rows.select("block", F.spark_partition_id().alias("at")).distinct().collect()
        assert many == 20 and {r["block"] for r in held} == set(range(many))
        assert all(r["at"] == r["block"] for r in held)
    # A step's rows stay there: only the values by block are dealt.
    table = spark.createDataFrame([(p, 1.0) for p in range(500)], "place_ int, v double")
    met = dealt.map(dealt.fetch(table, "place_"), "id long, at int", lambda own, there: [
        pa.table({"id": own.column("id"), "at": pa.array(np.full(own.num_rows, there.num_rows, np.int32))})])
    wanted = {}
    for r in dealt.rows.collect():
        wanted.setdefault(r.block, set()).update(r.indices)
    own = {r.id: r.block for r in dealt.rows.collect()}
    assert {r.id: r["at"] for r in met.collect()} == {i: len(wanted[b]) for i, b in own.items()}
