"""Topic models by EM.

State is three tables (section 1 of the survey):
    tokens(doc_id, term_id, cnt)            one row per non-zero count
    doc_topics(doc_id, n_0 .. n_{k-1})      N_kj
    term_topics(term_id, n_0 .. n_{k-1})    N_wk
Tokens are held as packed bags, one row per document, dealt into blocks once
(``blocks.Blocks``).  In an EM step a block fetches each of its terms' topic
counts once, numpy computes the k smoothed topic shares gamma of its tokens,
scales them by the count and adds them up per document and per term of the
block; so a step moves (block, term) rows, never tokens.  One aggregate totals
both tables and one write keeps them: plan and time per step stay the same
however many there are.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranking import number_rows
from ..session import scratch_table_dir
from ..sources.bags import entries
from .blocks import Blocks, Entries, block_of, lookup, numbers, totals
from .packed import Runs

DEFAULTS = dict(k=10, max_iter=20, optimizer="em")


def ncols(k: int, prefix: str = "n_") -> list[str]:
    return [f"{prefix}{j}" for j in range(k)]


def em_priors(k: int, alpha: float = -1.0, eta: float = -1.0) -> tuple[float, float]:
    """Auto priors for EM: alpha = 50/k + 1, eta = 1.1; both must be > 1."""
    a = 50.0 / k + 1.0 if alpha == -1.0 else float(alpha)
    e = 1.1 if eta == -1.0 else float(eta)
    if not a > 1.0:
        raise ValueError(f"EM needs docConcentration > 1, got {a}")
    if not e > 1.0:
        raise ValueError(f"EM needs topicConcentration > 1, got {e}")
    return a, e


def token_table(term_counts: DataFrame) -> DataFrame:
    """H2: one row per (doc, term), zero counts dropped."""
    return term_counts.select(F.col("doc_id").cast("long"), F.col("term_id").cast("int"),
                              F.col("cnt").cast("double")).where(F.col("cnt") != 0)


def as_bags(term_counts: DataFrame) -> DataFrame:
    """(doc_id, terms ARRAY<INT>, counts ARRAY<DOUBLE>), one row per document, of
    (doc_id, term_id, cnt) rows or of bags; each list is bounded by the
    document's distinct words."""
    if "terms" in term_counts.columns:
        return term_counts
    g = token_table(term_counts).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term_id", "cnt"))).alias("p"))
    return g.select("doc_id", F.col("p.term_id").alias("terms"), F.col("p.cnt").alias("counts"))


def deal_bags(bags: DataFrame) -> Blocks:
    """Bags in blocks, a document's rows in one of them."""
    return Blocks.deal(bags.select(F.col("doc_id").cast("long").alias("doc_id"), "terms", "counts"), F.col("doc_id"), "terms")


def _sum_back(scaled: DataFrame, k: int, cols: list[str]):
    """(document sums, term sums) of token rows, by one pass over them.

    Every token row counts under its document and under its term (two grouping
    sets of one aggregate, combined map-side).
    """
    return _written_sides(scaled.select(
        F.expr("stack(2, 'doc', doc_id, 'term', cast(term_id as bigint)) as (side, id)"), *cols), k, cols)


def _written_sides(sides: DataFrame, k: int, cols: list[str], once: bool = False):
    """(document sums, term sums) of rows (side, id, ..), written side by side,
    so that what made the rows runs once; ``once``: a task has a place in one row."""
    sums = [F.sum(c).alias(f"n_{j}") for j, c in enumerate(cols)]
    both = totals(sides, ["side", "id"], *sums) if once else sides.groupBy("side", "id").agg(*sums)
    path = scratch_table_dir(sides.sparkSession, f"topics-{uuid.uuid4().hex}")
    both.write.partitionBy("side").parquet(path)
    # The folder of a side is the only one read for it.
    rows = sides.sparkSession.read.schema(both.schema).parquet(path)
    return (rows.where("side = 'doc'").select(F.col("id").alias("doc_id"), *ncols(k)),
            rows.where("side = 'term'").select(F.col("id").cast("int").alias("term_id"), *ncols(k)))


def init_hash(tokens: DataFrame, k: int):
    """H3 with deterministic weights w_j = 1 + (doc*31 + term*17 + j*7) % 10
    (the oracle start); each token's count is split by w / sum(w)."""
    ws = [F.lit(1) + (F.col("doc_id") * 31 + F.col("term_id") * 17 + F.lit(7 * j)) % 10
          for j in range(k)]
    return _split_init(tokens, k, ws)


def init_random(tokens: DataFrame, k: int, seed: int = 0):
    """H3: a random topic split per token (uniform draws, normalised)."""
    # Draws are hashes of document, term and topic: the same on any cluster.
    us = [(F.pmod(F.xxhash64("doc_id", "term_id", F.lit(j), F.lit(seed)), F.lit(1 << 40)) + 1)
          / float(1 << 40) for j in range(k)]
    return _split_init(tokens, k, us)


def _split_init(tokens, k, ws):
    staged = tokens.select("doc_id", "term_id", "cnt",
                           *[w.cast("double").alias(f"_w{j}") for j, w in enumerate(ws)])
    tot = reduce(add, [F.col(f"_w{j}") for j in range(k)])
    scaled = staged.select("doc_id", "term_id", *[(F.col(f"_w{j}") / tot * F.col("cnt"))
                                                  .alias(f"_h{j}") for j in range(k)])
    return _sum_back(scaled, k, [f"_h{j}" for j in range(k)])


def init_hash_blocks(dealt: Blocks, k: int):
    """``init_hash`` of the blocks' tokens, by numpy."""
    def shares(doc, term):
        if len(doc) and max(abs(int(doc.min())), abs(int(doc.max()))) > (1 << 62) // 31:
            raise OverflowError("a document id is too large for the hash start")
        w = np.column_stack([1 + np.fmod(doc * 31 + term * 17 + 7 * j, 10) for j in range(k)]).astype(np.float64)
        total = w.sum(axis=1)
        if (total == 0).any():
            raise ZeroDivisionError("the start weights of a token add up to 0")
        return w / total[:, None]

    def rows(side, ids, values):
        for s in range(0, len(ids), 1 << 16):
            part = slice(s, s + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array([side] * len(ids[part]), pa.string()), pa.array(ids[part], pa.int64()), *(
                pa.nulls(len(ids[part]), pa.float64()) if values is None else pa.array(values[part, j]) for j in range(k))], names=names)

    names = ["side", "id", *(f"_h{j}" for j in range(k))]

    def run(batches):
        # A partition holds a block, packed: read for its terms, then for its sums.
        held = Runs([x for b in batches for x in b.column(1)])
        known, nameless = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for place in held.only("terms"):
            known = [np.unique(np.concatenate([*known, numbers(place.flatten())]))]
        known = known[0]
        total, met = np.zeros((len(known), k)), np.zeros(len(known), bool)
        for own in held:
            named = own.column("doc_id").is_valid()
            lost = Entries(own.filter(pa.compute.invert(named)), "terms", "counts")
            nameless.append(np.unique(lost.place[lost.value != 0]))
            own = own.filter(named)
            tokens, ids = Entries(own, "terms", "counts"), numbers(own.column("doc_id"))
            docs, seen = np.zeros((len(ids), k)), np.zeros(len(ids), bool)
            for i, to, part in tokens.slices(k):
                row = np.repeat(np.arange(i, to), tokens.sizes[i:to])
                live = np.flatnonzero(tokens.value[part] != 0)
                row, term, value = row[live], tokens.place[part][live], tokens.value[part][live]
                h, at = shares(ids[row], term.astype(np.int64)) * value[:, None], np.searchsorted(known, term)
                for j in range(k):
                    docs[i:to, j] += np.bincount(row - i, h[:, j], to - i)
                    total[:, j] += np.bincount(at, h[:, j], len(known))
                seen[row] = met[at] = True
            yield from rows("doc", ids[seen], docs[seen])
        yield from rows("term", known[met], total[met])
        # Tokens without a document count nothing, but are there.
        nameless = np.unique(np.concatenate(nameless))
        yield from rows("term", nameless, None)
        if len(nameless):
            yield pa.RecordBatch.from_arrays([pa.array(["doc"]), *(pa.nulls(1, t) for t in (pa.int64(), *[pa.float64()] * k))], names=names)

    schema = ", ".join(["side string", "id bigint", *(f"_h{j} double" for j in range(k))])
    return _written_sides(dealt.packed.mapInArrow(run, schema), k, [f"_h{j}" for j in range(k)], once=True)


def topic_totals(term_topics: DataFrame, k: int) -> np.ndarray:
    """H5: N_k = sum over term rows (one k-column aggregate)."""
    r = term_topics.agg(*[F.sum(c).alias(c) for c in ncols(k)]).first()
    return np.array([r[c] or 0.0 for c in ncols(k)], dtype=np.float64)


def _with_state(dealt: Blocks, doc_topics, term_topics, k: int, schema: str, fn) -> DataFrame:
    """fn(Blocks' runs) -> lists of columns by ``schema``, over every block's tokens
    whose document and term have topic counts."""
    docs = doc_topics.where("doc_id is not null").select(
        block_of(F.col("doc_id"), dealt.n).alias("of"), F.lit("doc").alias("side"), F.col("doc_id").alias("id"), *ncols(k))
    terms = dealt.fetch(term_topics, "term_id").select("of", F.lit("term").alias("side"), F.col("term_id").cast("long").alias("id"), *ncols(k))
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(own, state):
        if state.num_rows:
            yield from (pa.Table.from_arrays(columns, names=names) for columns in fn(Block.read(own, state, k)))

    return dealt.map_runs(docs.unionAll(terms), schema, run)


class Block:
    """A run of a block's tokens with the topic counts of the block's documents and terms."""

    def __init__(self, tokens: Entries, ids, own, term, doc_ids, docs, term_ids, terms):
        self.tokens, self.ids, self.own, self.term = tokens, ids, own, term
        self.doc_ids, self.docs, self.term_ids, self.terms = doc_ids, docs, term_ids, terms

    @staticmethod
    def read(held: Runs, state: pa.Table, k: int):
        """The block's runs one by one; what they have of the counts is the same arrays."""
        values = np.column_stack([numbers(state.column(c)) for c in ncols(k)])
        ids, is_doc = numbers(state.column("id")), numbers(state.column("side").combine_chunks().dictionary_encode().indices)
        names = state.column("side").combine_chunks().dictionary_encode().dictionary.to_pylist()
        sides = []
        for side in ("doc", "term"):
            rows = np.flatnonzero(is_doc == names.index(side)) if side in names else np.zeros(0, np.int64)
            rows = rows[np.argsort(ids[rows], kind="stable")]
            sides += [ids[rows], values[rows]]
        for own in held:
            own = own.filter(own.column("doc_id").is_valid())
            if own.num_rows:
                tokens = Entries(own, "terms", "counts")
                doc = numbers(own.column("doc_id"))
                yield Block(tokens, doc, lookup(sides[0], doc), lookup(sides[2], tokens.place), *sides)

    def slices(self, k: int):
        """(entries, own document rows, places of documents, places of terms) of
        tokens that have both and count."""
        for i, to, part in self.tokens.slices(k):
            row = np.repeat(np.arange(i, to), self.tokens.sizes[i:to])
            at, doc = self.term[part], self.own[row]
            met = np.flatnonzero((at >= 0) & (doc >= 0) & (self.tokens.value[part] != 0))
            yield part.start + met, row[met], doc[met], at[met]

    def gamma(self, doc, at, n_k, vocab_size, alpha, eta) -> np.ndarray:
        """gamma_j = (N_wj + eta - 1)(N_dj + alpha - 1) / (N_j + V(eta - 1)), normalised."""
        e1, a1 = eta - 1.0, alpha - 1.0
        g = (self.terms[at] + e1) * (self.docs[doc] + a1) / (n_k + vocab_size * e1)
        return g / g.sum(axis=1)[:, None]


def em_step(dealt: Blocks, doc_topics, term_topics, k, n_k, vocab_size, alpha, eta):
    """H4: one EM step -> (doc_topics, term_topics)."""
    def sums(runs):
        sides = None
        for b in runs:
            if sides is None:
                sides = [np.zeros_like(b.docs), np.zeros_like(b.terms)]
                met = [np.zeros(len(x), bool) for x in sides]
            for at, _, doc, term in b.slices(k):
                h = b.gamma(doc, term, n_k, vocab_size, alpha, eta) * b.tokens.value[at][:, None]
                for total, seen, place in zip(sides, met, (doc, term)):
                    for j in range(k):
                        total[:, j] += np.bincount(place, h[:, j], len(total))
                    seen[place] = True
        if sides is None:
            return
        for side, ids, total, seen in zip(("doc", "term"), (b.doc_ids, b.term_ids), sides, met):
            rows = np.flatnonzero(seen)
            yield [pa.array([side] * len(rows), pa.string()), pa.array(ids[rows], pa.int64()),
                   *(pa.array(total[rows, j]) for j in range(k))]

    schema = ", ".join(["side string", "id bigint", *(f"_h{j} double" for j in range(k))])
    return _written_sides(_with_state(dealt, doc_topics, term_topics, k, schema, sums), k, [f"_h{j}" for j in range(k)], once=True)


@dataclass
class EMLDAModel:
    dealt: Blocks
    doc_topics: DataFrame
    term_topics: DataFrame
    k: int
    vocab_size: int
    alpha: float
    eta: float
    n_k: np.ndarray
    trace: list = field(default_factory=list)

    @property
    def tokens(self) -> DataFrame:
        """H2: (doc_id, term_id, cnt)."""
        return token_table(entries(self.dealt.rows))

    # H6
    def topics_matrix(self) -> DataFrame:
        """(topic, term_id, weight = N_wk), long form via ``stack``."""
        pairs = ", ".join(f"{j}, n_{j}" for j in range(self.k))
        return self.term_topics.select(
            "term_id", F.expr(f"stack({self.k}, {pairs}) AS (topic, weight)")).select(
            F.col("topic").cast("int"), "term_id", "weight")

    # H7
    def describe_topics(self, max_terms: int | None = None) -> DataFrame:
        """Top terms per topic by N_wk / N_k (ties: lower term id); all terms
        by default.  row_number() <= n lets Catalyst prune per partition."""
        n_k = F.array(*[F.lit(float(v)) for v in self.n_k])
        t = self.topics_matrix().select("topic", "term_id",
                                        (F.col("weight") / n_k[F.col("topic")]).alias("weight"))
        if max_terms is not None:
            return top_n(t, "topic", "term_id", max_terms)
        # Every topic ranks all terms, so they follow one another in one sorted order.
        placed = number_rows(t, [F.col("topic"), F.col("weight").desc(), F.col("term_id")])
        terms = self.term_topics.count()
        return placed.select("topic", "term_id", "weight", (
            F.col("position") - F.col("topic") * F.lit(terms) + 1).cast("int").alias("rank"))

    # H12
    def topic_distributions(self) -> DataFrame:
        """(doc_id, theta ARRAY<DOUBLE>): N_kj normalised per document."""
        cols = [F.col(c) for c in ncols(self.k)]
        tot = reduce(add, cols)
        return self.doc_topics.select("doc_id", F.array(*[c / tot for c in cols]).alias("theta"))

    # H8
    def top_documents_per_topic(self, max_docs: int) -> DataFrame:
        from ..functions.columns import explode_clusters
        th = explode_clusters(self.topic_distributions(), ["doc_id"], self.k, arr="theta",
                              out="weight")
        return top_n(th.select(F.col("cluster").alias("topic"), "doc_id", "weight"), "topic",
                     "doc_id", max_docs)

    # H9
    def topic_assignments(self) -> DataFrame:
        """(doc_id, terms ARRAY<INT>, topics ARRAY<INT>) sorted by term; the
        per-document list is bounded by the vocabulary size."""
        args = self.n_k, self.vocab_size, self.alpha, self.eta
        k = self.k

        def best(runs):
            for b, at, row, doc, term in ((b, *x) for b in runs for x in b.slices(k)):
                if not len(at):
                    continue
                topic = np.argmax(b.gamma(doc, term, *args), axis=1)
                order = np.lexsort((topic, b.tokens.place[at], row))
                docs, sizes = np.unique(row, return_counts=True)
                lists = (pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(x[order].astype(np.int32)))
                         for x in (b.tokens.place[at], topic))
                yield [pa.array(b.ids[docs], pa.int64()), *lists]

        return _with_state(self.dealt, self.doc_topics, self.term_topics, k, "doc_id bigint, terms array<int>, topics array<int>", best)

    # H10
    def log_likelihood(self) -> float:
        """sum over tokens cnt * ln(phi_w . theta_d), smoothed as in EM."""
        k, e1, a1 = self.k, self.eta - 1.0, self.alpha - 1.0
        n_k, v = self.n_k, self.vocab_size

        def parts(runs):
            shares = None
            for b in runs:
                if shares is None:
                    shares = (b.docs + a1) / (b.docs + a1).sum(axis=1)[:, None]
                    words = (b.terms + e1) / (n_k + v * e1)
                yield [pa.array([float(sum(b.tokens.value[at] @ np.log(np.einsum("ij,ij->i", words[term], shares[doc]))
                                           for at, _, doc, term in b.slices(k)))])]

        out = _with_state(self.dealt, self.doc_topics, self.term_topics, k, "part double", parts)
        return float(out.agg(F.sum("part")).first()[0])

    # H11
    def log_prior(self) -> float:
        """(eta-1) sum log phi_wk over terms + (alpha-1) sum log theta_kj over
        documents (the intended sum; the reference's aggregate drops its
        accumulator)."""
        k, e1, a1 = self.k, self.eta - 1.0, self.alpha - 1.0
        terms = self.term_topics.agg(F.sum(reduce(add, [
            F.log((F.col(f"n_{i}") + F.lit(e1)) / F.lit(float(self.n_k[i]) + self.vocab_size * e1))
            for i in range(k)]))).first()[0] or 0.0
        dsum = reduce(add, [F.col(f"n_{i}") + F.lit(a1) for i in range(k)])
        docs = self.doc_topics.agg(F.sum(reduce(add, [
            F.log((F.col(f"n_{i}") + F.lit(a1)) / dsum) for i in range(k)]))).first()[0] or 0.0
        return float(e1 * terms + a1 * docs)

    # H13
    def top_topics_per_document(self, n: int) -> DataFrame:
        """(doc_id, topics ARRAY<INT>, weights ARRAY<DOUBLE>): first n by
        weight (ties: lower topic); weights are shares when the row sum is
        not 0."""
        cols = [F.col(c) for c in ncols(self.k)]
        tot = reduce(add, cols)
        structs = F.array(*[F.struct(c.alias("w"), F.lit(-j).alias("neg")) for j, c in
                            enumerate(cols)])
        top = F.slice(F.sort_array(structs, asc=False), 1, n)
        d = self.doc_topics.select("doc_id", tot.alias("_tot"), top.alias("_top"))
        return d.select("doc_id", F.transform("_top", lambda s: -s["neg"]).alias("topics"),
                        F.transform("_top", lambda s: F.when(F.col("_tot") != 0, s["w"] / F.col(
                            "_tot")).otherwise(s["w"])).alias("weights"))


def top_n(df: DataFrame, group: str, tie: str, n: int) -> DataFrame:
    """Rank rows within ``group`` by weight desc, ``tie`` asc; keep n (each
    task keeps its own first n before the shuffle)."""
    w = Window.partitionBy(group).orderBy(F.col("weight").desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= n)


def train_em(term_counts: DataFrame | Blocks, k: int = DEFAULTS["k"], max_iter: int = DEFAULTS["max_iter"],
             alpha: float = -1.0, eta: float = -1.0, vocab_size: int | None = None,
             seed: int = 0, init: str = "random") -> EMLDAModel:
    """H1 (EM).  ``init`` = "random" or "hash" (deterministic start).

    ``term_counts``: (doc_id, term_id, cnt) rows, bags or bags dealt into blocks by
    ``deal_bags`` or ``bag_blocks``.  Documents without any term drop out of the
    state (quirk Q19)."""
    a, e = em_priors(k, alpha, eta)
    dealt = term_counts if isinstance(term_counts, Blocks) else deal_bags(as_bags(term_counts))
    if vocab_size is None:
        vocab_size = int(dealt.wanted.agg(F.max("place")).first()[0]) + 1
    if init == "hash":
        doc, term = init_hash_blocks(dealt, k)
    else:
        doc, term = init_random(token_table(entries(dealt.rows)), k, seed)
    n_k = topic_totals(term, k)
    trace = []
    for it in range(1, max_iter + 1):
        t0 = time.time()
        doc, term = em_step(dealt, doc, term, k, n_k, vocab_size, a, e)
        n_k = topic_totals(term, k)
        trace.append(dict(iteration=it, seconds=time.time() - t0))
    return EMLDAModel(dealt, doc, term, k, vocab_size, a, e, n_k, trace)


def model_from_state(tokens, doc_topics, term_topics, k, vocab_size, alpha, eta) -> EMLDAModel:
    return EMLDAModel(deal_bags(as_bags(tokens)), doc_topics, term_topics, k, vocab_size, alpha, eta,
                      topic_totals(term_topics, k))
