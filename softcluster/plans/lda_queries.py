"""Registered topic-model queries (section H; A2, A10, A11).

Corpus: all ``documents``, whole texts, words = runs of letters, lower-cased,
every word in the vocabulary.  EM oracles start from the hash weights
1 + (doc*31 + term*17 + topic*7) % 10 and use k = 3 topics.  Online oracles
start from a lambda made from the term ids, a constant gamma and a fixed
number of inner passes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import draws
from ..operators import topics as TP
from ..sources import bags, store
from . import fixtures as X
from . import sqlgen as S
from .registry import query

K, STEPS, MANY_STEPS = 3, 2, 10
ALPHA, ETA = TP.em_priors(K)
V = "(SELECT count(*) FROM vocab)"


def corpus(spark, sf_dir):
    """(term counts, vocabulary) of every word of every document."""
    return bags.term_counts(X.table(spark, sf_dir, "documents"))


def term_counts(spark, sf_dir):
    return corpus(spark, sf_dir)[0]


def document_bags(spark, sf_dir):
    """(bags, vocabulary): the same counts, a row per document."""
    return bags.document_bags(X.table(spark, sf_dir, "documents"))


def em_model(spark, sf_dir, steps=STEPS):
    dealt = bags.bag_blocks(X.table(spark, sf_dir, "documents"))[0]
    return TP.train_em(dealt, k=K, max_iter=steps, init="hash")


# --- SQL -----------------------------------------------------------------------

def _corpus():
    return [
        S.cte("toks", "SELECT CAST(doc_id AS BIGINT) AS doc_id, "
                      "lower(unnest(regexp_extract_all(text, '\\p{L}+'))) AS word "
                      "FROM documents"),
        S.cte("dfreq", "SELECT word, count(DISTINCT doc_id) AS doc_freq FROM toks GROUP BY word"),
        S.cte("vocab", "SELECT word, CAST(row_number() OVER (ORDER BY doc_freq DESC, word) - 1 "
                       "AS INTEGER) AS term_id FROM dfreq"),
        S.cte("tc", "SELECT doc_id, term_id, CAST(count(*) AS DOUBLE) AS cnt FROM toks "
                    "JOIN vocab USING (word) GROUP BY doc_id, term_id"),
        S.cte("tok", "SELECT * FROM tc WHERE cnt <> 0"),
    ]


def _n(prefix="n"):
    return ", ".join(f"{prefix}{j}" for j in range(K))


def _init():
    ws = [f"CAST(1 + (doc_id * 31 + term_id * 17 + {7 * j}) % 10 AS DOUBLE)" for j in range(K)]
    tot = " + ".join(f"w{j}" for j in range(K))
    ctes = _corpus() + [
        S.cte("i_w", f"SELECT doc_id, term_id, cnt, {', '.join(f'{w} AS w{j}' for j, w in enumerate(ws))} "
                     "FROM tok"),
        S.cte("i_h", f"SELECT doc_id, term_id, {', '.join(f'w{j} / ({tot}) * cnt AS h{j}' for j in range(K))} "
                     "FROM i_w"),
    ]
    return ctes + _sum_back("0", "i_h")


def _sum_back(t, src):
    sums = ", ".join(f"sum(h{j}) AS n{j}" for j in range(K))
    return [S.cte(f"dt{t}", f"SELECT doc_id, {sums} FROM {src} GROUP BY doc_id"),
            S.cte(f"tt{t}", f"SELECT term_id, {sums} FROM {src} GROUP BY term_id"),
            S.cte(f"nk{t}", f"SELECT {', '.join(f'sum(n{j}) AS N{j}' for j in range(K))} FROM tt{t}")]


def _step(t):
    e1, a1 = ETA - 1.0, ALPHA - 1.0
    g = [f"(w.n{j} + {e1!r}) * (d.n{j} + {a1!r}) / (nk.N{j} + {V} * {e1!r}) AS g{j}" for j in range(K)]
    tot = " + ".join(f"g{j}" for j in range(K))
    p = t - 1
    return [S.cte(f"s{t}_g", f"SELECT tok.doc_id, tok.term_id, tok.cnt, {', '.join(g)} FROM tok "
                             f"JOIN dt{p} d USING (doc_id) JOIN tt{p} w USING (term_id), nk{p} nk"),
            S.cte(f"s{t}_h", f"SELECT doc_id, term_id, "
                             f"{', '.join(f'g{j} / ({tot}) * cnt AS h{j}' for j in range(K))} FROM s{t}_g")
            ] + _sum_back(str(t), f"s{t}_h")


def _em(steps):
    ctes = _init()
    for t in range(1, steps + 1):
        ctes += _step(t)
    return ctes


def _state_sql(t, digits=3):
    rows = []
    for j in range(K):
        rows.append(f"SELECT 'doc' AS side, doc_id AS id, CAST({j} AS INTEGER) AS topic, "
                    f"CAST(round(n{j}, {digits}) AS DOUBLE) AS n FROM dt{t}")
        rows.append(f"SELECT 'term' AS side, CAST(term_id AS BIGINT) AS id, CAST({j} AS INTEGER) AS topic, "
                    f"CAST(round(n{j}, {digits}) AS DOUBLE) AS n FROM tt{t}")
    return "\nUNION ALL\n".join(rows)


def _state_out(doc, term, digits=3):
    def long(df, side, key):
        pairs = ", ".join(f"{j}, n_{j}" for j in range(K))
        return df.select(F.lit(side).alias("side"), F.col(key).cast("long").alias("id"),
                         F.expr(f"stack({K}, {pairs}) AS (topic, n)")).select(
            "side", "id", F.col("topic").cast("int").alias("topic"),
            F.round("n", digits).alias("n"))
    return long(doc, "doc", "doc_id").unionByName(long(term, "term", "term_id"))


# A2 / H2 / H22 ---------------------------------------------------------------------

@query("lda_term_counts", lambda: S.with_(_corpus(), "SELECT doc_id, term_id, cnt FROM tc"))
def lda_term_counts(spark, sf_dir):
    """A2: whole texts -> (doc_id, term_id, cnt) over every word."""
    return term_counts(spark, sf_dir)


@query("lda_token_table", lambda: S.with_(_corpus(), "SELECT doc_id, term_id, cnt FROM tok"))
def lda_token_table(spark, sf_dir):
    return TP.token_table(term_counts(spark, sf_dir))


@query("lda_corpus_stats", lambda: S.with_(
    _corpus(), "SELECT count(DISTINCT doc_id) AS docs, count(DISTINCT term_id) AS terms, "
               "sum(cnt) AS tokens FROM tc"))
def lda_corpus_stats(spark, sf_dir):
    return bags.corpus_stats(term_counts(spark, sf_dir))


# H3 / H4 / H5 / H1 --------------------------------------------------------------------

@query("lda_em_init", lambda: S.with_(_init(), _state_sql(0, 6)))
def lda_em_init(spark, sf_dir):
    """H3 with the deterministic hash split."""
    doc, term = TP.init_hash(TP.token_table(term_counts(spark, sf_dir)), K)
    return _state_out(doc, term, 6)  # shares are fractions of four decimals or endless ones


@query("lda_em_step", lambda: S.with_(_em(1), _state_sql(1)))
def lda_em_step(spark, sf_dir):
    """H4: one EM step from the hash start."""
    m = em_model(spark, sf_dir, 1)
    return _state_out(m.doc_topics, m.term_topics)


@query("lda_topic_totals", lambda: S.with_(_em(1), "\nUNION ALL\n".join(
    f"SELECT CAST({j} AS INTEGER) AS topic, CAST(round(N{j}, 6) AS DOUBLE) AS total FROM nk1"
    for j in range(K))))
def lda_topic_totals(spark, sf_dir):
    m = em_model(spark, sf_dir, 1)
    return spark.createDataFrame([(j, round(float(v), 6)) for j, v in enumerate(m.n_k)],
                                 "topic int, total double")


@query("lda_train_em", lambda: S.with_(_em(STEPS), _state_sql(STEPS)))
def lda_train_em(spark, sf_dir):
    """H1 (EM): 2 steps from the hash start, auto priors alpha = 50/k + 1, eta = 1.1."""
    m = em_model(spark, sf_dir)
    return _state_out(m.doc_topics, m.term_topics)


@query("lda_train_em_many", lambda: S.with_(_em(MANY_STEPS), _state_sql(MANY_STEPS)))
def lda_train_em_many(spark, sf_dir):
    """H1 (EM): 10 steps from the hash start."""
    m = em_model(spark, sf_dir, MANY_STEPS)
    return _state_out(m.doc_topics, m.term_topics)


@query("lda_em_init_random")
def lda_em_init_random(spark, sf_dir):
    """H3: the random split of every token's count (rows-only)."""
    return _state_out(*TP.init_random(TP.token_table(term_counts(spark, sf_dir)), K, seed=4))


# H6 / H7 / H8 ---------------------------------------------------------------------------

def _topics_sql():
    return "\nUNION ALL\n".join(
        f"SELECT CAST({j} AS INTEGER) AS topic, term_id, CAST(round(n{j}, 3) AS DOUBLE) AS weight "
        f"FROM tt{STEPS}" for j in range(K))


@query("lda_topics_matrix", lambda: S.with_(_em(STEPS), _topics_sql()))
def lda_topics_matrix(spark, sf_dir):
    m = em_model(spark, sf_dir)
    return m.topics_matrix().select("topic", "term_id", F.round("weight", 3).alias("weight"))


TOP_TERMS, TOP_DOCS, TOP_TOPICS = 5, 3, 2


def _describe_sql():
    rows = "\nUNION ALL\n".join(
        f"SELECT CAST({j} AS INTEGER) AS topic, term_id, n{j} / (SELECT N{j} FROM nk{STEPS}) AS weight "
        f"FROM tt{STEPS}" for j in range(K))
    body = (f"SELECT topic, rank, term_id, CAST(round(weight, 6) AS DOUBLE) AS weight FROM ("
            f"SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term_id) "
            f"AS INTEGER) AS rank FROM ({rows})) WHERE rank <= {TOP_TERMS}")
    return S.with_(_em(STEPS), body)


@query("lda_describe_topics", _describe_sql)
def lda_describe_topics(spark, sf_dir):
    """H7: top 5 terms per topic, weight N_wk / N_k."""
    m = em_model(spark, sf_dir)
    return m.describe_topics(TOP_TERMS).select("topic", "rank", "term_id",
                                               F.round("weight", 6).alias("weight"))


def _theta_rows():
    tot = " + ".join(f"n{j}" for j in range(K))
    return "\nUNION ALL\n".join(
        f"SELECT doc_id, CAST({j} AS INTEGER) AS topic, n{j} / ({tot}) AS weight FROM dt{STEPS}"
        for j in range(K))


def _top_docs_sql():
    body = (f"SELECT topic, rank, doc_id, CAST(round(weight, 6) AS DOUBLE) AS weight FROM ("
            f"SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY weight DESC, doc_id) "
            f"AS INTEGER) AS rank FROM ({_theta_rows()})) WHERE rank <= {TOP_DOCS}")
    return S.with_(_em(STEPS), body)


@query("lda_top_docs", _top_docs_sql)
def lda_top_docs(spark, sf_dir):
    """H8: top 3 documents per topic by topic share."""
    m = em_model(spark, sf_dir)
    return m.top_documents_per_topic(TOP_DOCS).select("topic", "rank", "doc_id",
                                                      F.round("weight", 6).alias("weight"))


# H9 - H13 -------------------------------------------------------------------------------

def _assign_sql():
    t = STEPS + 1
    ctes = _em(STEPS) + _step(t)[:1]
    best = S.argmax_expr(K, "g")
    body = (f"SELECT doc_id, string_agg(CAST(term_id AS VARCHAR), ',' ORDER BY term_id) AS terms, "
            f"string_agg(CAST(tp AS VARCHAR), ',' ORDER BY term_id) AS topics FROM "
            f"(SELECT doc_id, term_id, {best} AS tp FROM s{t}_g) GROUP BY doc_id")
    return S.with_(ctes, body)


@query("lda_topic_assignments", _assign_sql)
def lda_topic_assignments(spark, sf_dir):
    """H9: most likely topic per (doc, term), arrays sorted by term."""
    m = em_model(spark, sf_dir)
    out = m.topic_assignments()
    return out.select("doc_id", F.array_join(F.col("terms").cast("array<string>"), ",")
                      .alias("terms"),
                      F.array_join(F.col("topics").cast("array<string>"), ",").alias("topics"))


def _loglik_sql():
    e1, a1 = ETA - 1.0, ALPHA - 1.0
    dsum = " + ".join(f"(d.n{j} + {a1!r})" for j in range(K))
    dot = " + ".join(f"(w.n{j} + {e1!r}) / (nk.N{j} + {V} * {e1!r}) * ((d.n{j} + {a1!r}) / ({dsum}))"
                     for j in range(K))
    body = (f"SELECT CAST(round(sum(tok.cnt * ln({dot})), 1) AS DOUBLE) AS log_likelihood FROM tok "
            f"JOIN dt{STEPS} d USING (doc_id) JOIN tt{STEPS} w USING (term_id), nk{STEPS} nk")
    return S.with_(_em(STEPS), body)


@query("lda_log_likelihood", _loglik_sql)
def lda_log_likelihood(spark, sf_dir):
    m = em_model(spark, sf_dir)
    return spark.createDataFrame([(round(m.log_likelihood(), 1),)], "log_likelihood double")


def _prior_sql():
    e1, a1 = ETA - 1.0, ALPHA - 1.0
    terms = " + ".join(f"ln((n{j} + {e1!r}) / ((SELECT N{j} FROM nk{STEPS}) + {V} * {e1!r}))"
                       for j in range(K))
    dsum = " + ".join(f"(n{j} + {a1!r})" for j in range(K))
    docs = " + ".join(f"ln((n{j} + {a1!r}) / ({dsum}))" for j in range(K))
    body = (f"SELECT CAST(round({e1!r} * (SELECT sum({terms}) FROM tt{STEPS}) + "
            f"{a1!r} * (SELECT sum({docs}) FROM dt{STEPS}), 1) AS DOUBLE) AS log_prior")
    return S.with_(_em(STEPS), body)


@query("lda_log_prior", _prior_sql)
def lda_log_prior(spark, sf_dir):
    m = em_model(spark, sf_dir)
    return spark.createDataFrame([(round(m.log_prior(), 1),)], "log_prior double")


@query("lda_doc_topics", lambda: S.with_(
    _em(STEPS), f"SELECT doc_id, topic, CAST(round(weight, 6) AS DOUBLE) AS theta FROM ({_theta_rows()})"))
def lda_doc_topics(spark, sf_dir):
    """Topic mix of each training document."""
    m = em_model(spark, sf_dir)
    return m.topic_distributions().select(
        "doc_id", F.posexplode("theta").alias("topic", "theta")).select(
        "doc_id", F.col("topic").cast("int").alias("topic"), F.round("theta", 6).alias("theta"))


def _top_topics_sql():
    body = (f"SELECT doc_id, rank, topic, CAST(round(weight, 6) AS DOUBLE) AS weight FROM ("
            f"SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, topic) "
            f"AS INTEGER) AS rank FROM ({_theta_rows()})) WHERE rank <= {TOP_TOPICS}")
    return S.with_(_em(STEPS), body)


@query("lda_top_topics_per_doc", _top_topics_sql)
def lda_top_topics_per_doc(spark, sf_dir):
    """The 2 heaviest topics per document with their shares."""
    m = em_model(spark, sf_dir)
    t = m.top_topics_per_document(TOP_TOPICS)
    z = t.select("doc_id", F.posexplode(F.arrays_zip("topics", "weights")).alias("pos", "tw"))
    return z.select("doc_id", (F.col("pos") + 1).cast("int").alias("rank"),
                    F.col("tw.topics").alias("topic"), F.round("tw.weights", 6).alias("weight"))


# A10 / A11 -------------------------------------------------------------------------------

@query("lda_topics_roundtrip", lambda: S.with_(_em(STEPS), _topics_sql()))
def lda_topics_roundtrip(spark, sf_dir):
    """A10: topics table + meta (k, vocabulary size, alpha, eta) saved and loaded."""
    m = em_model(spark, sf_dir)
    path = store.save_topics(m.topics_matrix(), K, m.vocab_size, [ALPHA] * K, ETA)
    topics, meta = store.load_topics(spark, path)
    assert meta["k"] == K and meta["vocab_size"] == m.vocab_size
    return topics.select("topic", "term_id", F.round("weight", 3).alias("weight"))


@query("lda_state_roundtrip", lambda: S.with_(_em(STEPS), _state_sql(STEPS)))
def lda_state_roundtrip(spark, sf_dir):
    """The three training-state tables saved and loaded."""
    m = em_model(spark, sf_dir)
    path = store.save_lda_state(m.tokens, m.doc_topics, m.term_topics, K, m.vocab_size, [ALPHA] * K, ETA)
    _, doc, term, _ = store.load_lda_state(spark, path)
    return _state_out(doc, term)


# H14 - H21, H1 online ----------------------------------------------------------------------

from ..operators import topics_online as OL  # noqa: E402

OK_TOPICS, OFRACTION, OITERS, PASSES = 3, 0.05, 4, 3
RHO = (1024.0 + 1) ** -0.51
HOW = OL.Inference(start=1.0, passes=PASSES)


def _bags(spark, sf_dir):
    return document_bags(spark, sf_dir)[0]


def _given(spark, sf_dir):
    """(bags, model): lambda = 1 + (term * 17 + topic * 7) % 10 / 10."""
    docs, vocab = document_bags(spark, sf_dir)
    lam = vocab.select("term_id", F.array(*[
        F.lit(1.0) + (F.col("term_id") * 17 + 7 * j) % 10 / F.lit(10.0) for j in range(K)]).alias("w"))
    a, e = OL.online_priors(K)
    return docs, OL.OnlineLDAModel(lam, K, vocab.count(), a, e)


def _online_model(spark, sf_dir, optimize_alpha=False):
    return OL.train_online(_bags(spark, sf_dir), k=OK_TOPICS, max_iter=OITERS,
                           fraction=OFRACTION, seed=5, optimize_alpha=optimize_alpha)


# --- SQL: digamma and trigamma by eight recurrences and the asymptotic series

def _psi(x):
    y = f"({x} + 8)"
    back = " + ".join(f"1.0 / ({x} + {i})" for i in range(8))
    return (f"(ln({y}) - 0.5 / {y} - 1.0 / (12 * {y} ** 2) + 1.0 / (120 * {y} ** 4) - 1.0 / (252 * {y} ** 6) "
            f"+ 1.0 / (240 * {y} ** 8) - 1.0 / (132 * {y} ** 10) + 691.0 / (32760 * {y} ** 12) - ({back}))")


def _psi1(x):
    y = f"({x} + 8)"
    back = " + ".join(f"1.0 / ({x} + {i}) ** 2" for i in range(8))
    return (f"(1.0 / {y} + 0.5 / {y} ** 2 + 1.0 / (6 * {y} ** 3) - 1.0 / (30 * {y} ** 5) + 1.0 / (42 * {y} ** 7) "
            f"- 1.0 / (30 * {y} ** 9) + 5.0 / (66 * {y} ** 11) + {back})")


def _each(form, sep=", "):
    return sep.join(form.format(j=j) for j in range(K))


def _theta_of(t):
    """E[log theta] (o0..) and its exponentials (h0..) of gamma table g{t}."""
    return [S.cte(f"q{t}", f"SELECT *, {_each('g{j}', ' + ')} AS gs FROM g{t}"),
            S.cte(f"o{t}", f"SELECT *, {', '.join(f'{_psi(f"g{j}")} - {_psi("gs")} AS o{j}' for j in range(K))} FROM q{t}"),
            S.cte(f"h{t}", f"SELECT *, {_each('exp(o{j}) AS h{j}')} FROM o{t}")]


def _inferred():
    ctes = _corpus() + [
        S.cte("lam", "SELECT term_id, " + ", ".join(
            f"1.0::DOUBLE + (term_id * 17 + {7 * j}) % 10 / 10.0::DOUBLE AS l{j}" for j in range(K)) + " FROM vocab"),
        S.cte("ls", f"SELECT {_each('sum(l{j}) AS s{j}')} FROM lam"),
        S.cte("el", "SELECT term_id, " + ", ".join(f"{_psi(f'l{j}')} - {_psi(f's{j}')} AS e{j}" for j in range(K)) + " FROM lam, ls"),
        S.cte("be", f"SELECT term_id, {_each('e{j}')}, {_each('exp(e{j}) AS b{j}')} FROM el"),
        S.cte("g0", f"SELECT doc_id, {_each('1.0::DOUBLE AS g{j}')} FROM (SELECT DISTINCT doc_id FROM tok)"),
    ]
    dot = _each("b{j} * h{j}", " + ")
    for t in range(PASSES):
        ctes += _theta_of(t)
        pulled = ", ".join(f"any_value(h{j}) * sum(b{j} * cnt / ({dot} + 1e-100)) + {1.0 / K!r} AS g{j}" for j in range(K))
        ctes.append(S.cte(f"g{t + 1}", f"SELECT doc_id, {pulled} FROM tok JOIN be USING (term_id) "
                                       f"JOIN h{t} USING (doc_id) GROUP BY doc_id"))
    return ctes + _theta_of(PASSES)


def _long(value, key, source, name, digits=6):
    return "\nUNION ALL\n".join(
        f"SELECT {key}, CAST({j} AS INTEGER) AS topic, CAST(round({value.format(j=j)}, {digits}) AS DOUBLE) AS {name} "
        f"FROM {source}" for j in range(K))


def _stats_ctes():
    dot = _each("b{j} * h{j}", " + ")
    return _inferred() + [S.cte("st", "SELECT term_id, " + ", ".join(
        f"any_value(b{j}) * sum(h{j} * cnt / ({dot} + 1e-100)) AS v{j}" for j in range(K)) +
        f" FROM tok JOIN be USING (term_id) JOIN h{PASSES} USING (doc_id) GROUP BY term_id")]


def _alpha_sql():
    a = 1.0 / K
    ctes = _inferred() + [
        S.cte("ml", f"SELECT {_each('avg(o{j}) AS m{j}')} FROM o{PASSES}"),
        S.cte("gr", "SELECT " + ", ".join(
            f"m{j} - ({_psi(repr(a))} - {_psi(repr(a * K))}) AS r{j}" for j in range(K)) +
            f", {_psi1(repr(a * K))} AS z, 1.0 / {_psi1(repr(a))} AS d FROM ml"),
        S.cte("nw", "SELECT " + ", ".join(
            f"{a!r} + {RHO!r} * d * (r{j} + z * d * ({_each('r{j}', ' + ')}) / (1.0 - z * d * {K})) AS a{j}" for j in range(K)) + " FROM gr")]
    return S.with_(ctes, "\nUNION ALL\n".join(
        f"SELECT CAST({j} AS INTEGER) AS topic, CAST(round(a{j}, 6) AS DOUBLE) AS alpha FROM nw" for j in range(K)))


def _bound_ctes():
    words = f"ln({_each('exp(h.o{j} + e{j})', ' + ')})"
    a, e = 1.0 / K, 1.0 / K
    docs = " + ".join(f"({a!r} - g{j}) * o{j} + lgamma(g{j}) - lgamma({a!r})" for j in range(K))
    cells = " + ".join(f"({e!r} - l{j}) * e{j} + lgamma(l{j}) - lgamma({e!r})" for j in range(K))
    return _inferred() + [S.cte("bd", f"""SELECT
(SELECT sum(cnt * {words}) FROM tok JOIN be USING (term_id) JOIN h{PASSES} h USING (doc_id))
+ (SELECT sum({docs} + lgamma({a * K!r}) - lgamma(gs)) FROM h{PASSES})
+ (SELECT sum({cells}) FROM lam JOIN be USING (term_id))
+ {K} * lgamma({e!r} * {V}) - (SELECT {_each('lgamma(s{j})', ' + ')} FROM ls) AS bound""")]


def _minibatch_sql():
    steps = ", ".join(f"{s!r}::DOUBLE" for s in draws.poisson_steps(OFRACTION))
    return S.with_([*_corpus(), S.cte("u", f"SELECT doc_id, {draws.uniform_sql(3, 'doc_id')} AS u FROM (SELECT DISTINCT doc_id FROM tok)")],
                   f"SELECT doc_id FROM (SELECT doc_id, unnest(generate_series(1, len(list_filter([{steps}], lambda s: s <= u)))) FROM u)")


@query("lda_minibatch", _minibatch_sql)
def lda_minibatch(spark, sf_dir):
    """Documents drawn with replacement, fraction 0.05."""
    return OL.minibatch(_bags(spark, sf_dir), OFRACTION, True, seed=3).select("doc_id")


@query("lda_infer", lambda: S.with_(_inferred(), _long("g{j}", "doc_id", f"g{PASSES}", "gamma", 4)))
def lda_infer(spark, sf_dir):
    """H15 over the whole corpus: variational gamma per document, 3 passes
    from gamma = 1 under the given lambda."""
    docs, model = _given(spark, sf_dir)
    return model.gammas(docs, HOW).select("doc_id", F.posexplode("gamma").alias("topic", "gamma")).select(
        "doc_id", "topic", F.round("gamma", 4).alias("gamma"))


@query("lda_online_stats", lambda: S.with_(_stats_ctes(), _long("v{j}", "term_id", "st", "value", 3)))
def lda_online_stats(spark, sf_dir):
    """The corpus's statistics x exp(E[log beta]) per (topic, term)."""
    docs, model = _given(spark, sf_dir)
    stats = OL.batch_stats(docs, OL.elog_beta(model.lam, K), model.alpha, HOW).where("term_id >= 0")
    return stats.select("term_id", F.posexplode("value").alias("topic", "value")).select(
        "term_id", "topic", F.round("value", 3).alias("value"))


def _online_lambda_sql():
    d = "(SELECT count(DISTINCT doc_id) FROM tok)"
    eta = 1.0 / K
    body = "\nUNION ALL\n".join(
        f"SELECT CAST({j} AS INTEGER) AS topic, l.term_id, CAST(round({1.0 - RHO!r} * l.n{j} + "
        f"{RHO!r} * (coalesce(s.n{j}, 0.0) * ({d} / ceil({OFRACTION!r} * {d})) + {eta!r}), 3) "
        f"AS DOUBLE) AS weight FROM tt0 l LEFT JOIN tt1 s USING (term_id)" for j in range(K))
    return S.with_(_em(1), body)


@query("lda_online_lambda", _online_lambda_sql)
def lda_online_lambda(spark, sf_dir):
    """H17 on data-derived tables: lambda = the hash-start term-topic table,
    stat = the table after one EM step; D documents, B = ceil(0.05 D),
    rho = (1024 + 1)^-0.51, eta = 1/k."""
    import math
    m = em_model(spark, sf_dir, 1)
    tokens = m.tokens
    _, term0 = TP.init_hash(tokens, K)
    wide = F.array(*[F.col(f"n_{j}") for j in range(K)])
    docs = tokens.select("doc_id").distinct().count()
    out = OL.update_lambda(term0.select("term_id", wide.alias("w")), m.term_topics.select("term_id", wide.alias("value")),
                           RHO, docs, int(math.ceil(OFRACTION * docs)), 1.0 / K)
    return out.select("term_id", F.posexplode("w").alias("topic", "weight")).select(
        "topic", "term_id", F.round("weight", 3).alias("weight"))


@query("lda_online_alpha", _alpha_sql)
def lda_online_alpha(spark, sf_dir):
    """Alpha after one Newton step on the whole corpus."""
    docs, model = _given(spark, sf_dir)
    stats = OL.batch_stats(docs, OL.elog_beta(model.lam, K), model.alpha, HOW)
    new = OL.update_alpha(model.alpha, OL.mean_elog(stats), RHO)
    return spark.createDataFrame([(j, round(float(v), 6)) for j, v in enumerate(new)],
                                 "topic int, alpha double")


@query("lda_train_online")
def lda_train_online(spark, sf_dir):
    """H1 (online): 4 mini-batches, k = 3, alpha moving; the lambda table."""
    return _online_model(spark, sf_dir, optimize_alpha=True).topics()


ONLINE_STEPS = 2


def _train_online_sql():
    """Mini-batches by keyed draws; a document drawn n times counts n times."""
    steps = ", ".join(f"{s!r}::DOUBLE" for s in draws.poisson_steps(OFRACTION))
    d = "(SELECT count(DISTINCT doc_id) FROM tok)"
    dot = _each("b{j} * h{j}", " + ")
    ctes = _inferred()[:len(_corpus()) + 1]  # the words and the given lambda
    prev = "lam"
    for it in range(1, ONLINE_STEPS + 1):
        rho = (1024.0 + it) ** -0.51
        ctes += [
            S.cte(f"ls{it}", f"SELECT {_each('sum(l{j}) AS s{j}')} FROM {prev}"),
            S.cte(f"be{it}", "SELECT term_id, " + ", ".join(f"exp({_psi(f'l{j}')} - {_psi(f's{j}')}) AS b{j}" for j in range(K)) + f" FROM {prev}, ls{it}"),
            S.cte(f"dr{it}", f"SELECT doc_id, len(list_filter([{steps}], lambda s: s <= u)) AS n FROM "
                             f"(SELECT doc_id, {draws.uniform_sql(5 * 100003 + it - 1, 'doc_id')} AS u FROM (SELECT DISTINCT doc_id FROM tok))"),
            S.cte(f"bt{it}", f"SELECT doc_id, term_id, cnt, n FROM tok JOIN dr{it} USING (doc_id) WHERE n > 0"),
            S.cte(f"g{it}0", f"SELECT doc_id, {_each('1.0::DOUBLE AS g{j}')} FROM (SELECT DISTINCT doc_id FROM bt{it})")]
        for t in range(PASSES):
            ctes += _theta_of(f"{it}{t}")
            pulled = ", ".join(f"any_value(h{j}) * sum(b{j} * cnt / ({dot} + 1e-100)) + {1.0 / K!r} AS g{j}" for j in range(K))
            ctes.append(S.cte(f"g{it}{t + 1}", f"SELECT doc_id, {pulled} FROM bt{it} JOIN be{it} USING (term_id) "
                                               f"JOIN h{it}{t} USING (doc_id) GROUP BY doc_id"))
        ctes += _theta_of(f"{it}{PASSES}")
        ctes += [
            S.cte(f"st{it}", "SELECT term_id, " + ", ".join(f"any_value(b{j}) * sum(n * h{j} * cnt / ({dot} + 1e-100)) AS v{j}" for j in range(K)) +
                  f" FROM bt{it} JOIN be{it} USING (term_id) JOIN h{it}{PASSES} USING (doc_id) GROUP BY term_id"),
            S.cte(f"lam{it}", "SELECT term_id, " + ", ".join(
                f"{1.0 - rho!r} * l{j} + {rho!r} * (coalesce(v{j}, 0.0) * ({d} / ceil({OFRACTION!r} * {d})) + {1.0 / K!r}) AS l{j}" for j in range(K)) +
                f" FROM {prev} LEFT JOIN st{it} USING (term_id)")]
        prev = f"lam{it}"
    return S.with_(ctes, _long("l{j}", "term_id", prev, "weight"))


@query("lda_train_online_given", _train_online_sql)
def lda_train_online_given(spark, sf_dir):
    """H1 (online): two mini-batches by keyed draws from a given lambda, three inner passes."""
    docs, model = _given(spark, sf_dir)
    fit = OL.train_online(docs, k=K, max_iter=ONLINE_STEPS, fraction=OFRACTION, seed=5, optimize_alpha=False,
                          vocab_size=model.vocab_size, lam=model.lam, how=HOW)
    return fit.lam.select("term_id", F.posexplode("w").alias("topic", "weight")).select(
        "term_id", "topic", F.round("weight", 6).alias("weight"))


@query("lda_transform", lambda: S.with_(_inferred(), _long("g{j} / gs", "doc_id", f"q{PASSES}", "theta")))
def lda_transform(spark, sf_dir):
    """Topic mix of every document under the given lambda."""
    docs, model = _given(spark, sf_dir)
    return model.transform(docs, how=HOW).select("doc_id", F.posexplode("theta").alias("topic", "theta")).select(
        "doc_id", "topic", F.round("theta", 6).alias("theta"))


@query("lda_bound", lambda: S.with_(_bound_ctes(), "SELECT CAST(round(bound, 1) AS DOUBLE) AS bound FROM bd"))
def lda_bound(spark, sf_dir):
    """Variational bound of the corpus under the given lambda."""
    docs, model = _given(spark, sf_dir)
    return spark.createDataFrame([(round(model.log_likelihood(docs, how=HOW), 1),)], "bound double")


@query("lda_perplexity", lambda: S.with_(
    _bound_ctes(), "SELECT CAST(round(-bound / (SELECT sum(cnt) FROM tok), 6) AS DOUBLE) AS log_perplexity FROM bd"))
def lda_perplexity(spark, sf_dir):
    """-bound / tokens."""
    docs, model = _given(spark, sf_dir)
    return spark.createDataFrame([(round(model.log_perplexity(docs, how=HOW), 6),)], "log_perplexity double")
