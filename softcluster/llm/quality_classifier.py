"""Quality classifier by co-training two views (operator 2).

One view is a text's content: frequencies of its words and of the runs between
them, hashed, and a few shares over the whole text.  The other is the page's
metadata: language, source and length.  A logistic model of each view is
fitted on labelled documents; in every round each model labels the pool
documents it is surest of for the other one, and both are fitted again.  The
views are calibrated on held-out labels and combined into one probability of
being good, meaning of good quality and not toxic.

Models are fitted on the driver on a bounded sample (``labelled`` documents
per label and ``pool`` others, chosen by a hash of the id).  Reading features
of the sample and scoring the documents, whole texts each, are Spark jobs.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softcluster.llm import words as W

TEXT_BITS, PAGE_BITS = 18, 12
SHARES = 6
SCALE = 10.0


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashed columns and values (logarithmic counts of unit length, by
    row and column) and the rows' shares."""
    n = len(offsets) - 1
    low = W.LOWER[data]
    starts, ends, first = W.spans(low, offsets, W.ALNUM)
    word = W.hashes(low, starts, ends)
    n_words = np.diff(first)
    word_row = np.repeat(np.arange(n), n_words)
    gaps, gap_ends, _ = W.spans(low, offsets, ~W.ALNUM)
    odd = (gap_ends - gaps > 1) | (low[gaps] != 32)
    gaps, gap_ends = gaps[odd], gap_ends[odd]
    gap = W.hashes(low, gaps, gap_ends)
    gap_row = np.searchsorted(offsets, gaps, "right") - 1
    rows = np.concatenate([word_row, gap_row])
    columns = (np.concatenate([word, W.mix(gap + np.uint64(1))]) >> np.uint64(64 - TEXT_BITS)).astype(np.int64)
    key, times = np.unique(rows << TEXT_BITS | columns, return_counts=True)
    rows, columns = key >> TEXT_BITS, key & ((1 << TEXT_BITS) - 1)
    values = 1 + np.log(times)
    values *= SCALE / np.sqrt(np.maximum(1, np.bincount(rows, values ** 2, n)))[rows]

    def share(of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(1, np.diff(offsets))

    key = W.shingles(word, 3)
    at = np.arange(len(key))
    key = key[at + 3 <= first[word_row[at] + 1]]
    key_row = word_row[at][at + 3 <= first[word_row[at] + 1]]
    order = np.lexsort((key, key_row))
    again = (np.diff(key[order].view(np.int64)) == 0) & (np.diff(key_row[order]) == 0)
    repeated = np.bincount(key_row[order][1:][again], minlength=n) / np.maximum(1, n_words - 2)
    shares = np.column_stack([
        repeated, share((data >= 65) & (data <= 90)), share((data < 128) & ~W.ALNUM[data] & W.SOLID[data]),
        share((data >= 48) & (data <= 57)), np.log1p(n_words) / 10, np.bincount(word_row, ends - starts, n) / np.maximum(1, n_words) / 20])
    return rows, columns, values, SCALE * shares


def page_columns(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Each row's columns: language, source, both, and length by half powers of two."""
    known: dict[tuple, list[int]] = {}
    out = []
    for row in zip(lang, source, n_chars):
        length = None if row[2] is None else int(2 * np.log2(max(1, row[2])))
        key = (*row[:2], length)
        if key not in known:
            known[key] = [zlib.crc32(repr(x).encode()) % (1 << PAGE_BITS)
                          for x in (("lang", row[0]), ("source", row[1]), ("both", row[:2]), ("length", length))]
        out.append(known[key])
    return np.array(out, np.int64).reshape(-1, 4)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Rows:
    """A sparse matrix by rows: ``first`` has where each row begins, and the end."""
    first: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.values * w.astype(np.float32)[self.columns], dtype=float)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def back(self, g: np.ndarray) -> np.ndarray:
        each = np.repeat(g.astype(np.float32), np.diff(self.first))
        return np.bincount(self.columns, self.values * each, self.width)

    def take(self, keep: np.ndarray) -> Rows:
        sizes = np.diff(self.first)
        own = np.repeat(keep, sizes)
        return Rows(np.concatenate([[0], np.cumsum(sizes[keep])]), self.columns[own], self.values[own], self.width)


def ratios(x: Rows, y: np.ndarray, weight: np.ndarray, least: int = 3) -> np.ndarray:
    """How differently the classes show each column: absolute logarithmic ratios
    of the shares of rows with it; 0 for columns of fewer than ``least`` rows."""
    sizes = np.diff(x.first)
    share = [np.bincount(x.columns, np.repeat(weight * (y == c), sizes), x.width) / weight[y == c].sum() for c in (0, 1)]
    seen = np.bincount(x.columns, minlength=x.width)
    smooth = least / len(y)
    return np.where(seen >= least, abs(np.log((share[1] + smooth) / (share[0] + smooth))), 0.0)


def fit(x: Rows, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, steps: int = 60, rate: float = 0.3) -> np.ndarray:
    """Logistic weights, the last one the constant, by Adam on the whole sample."""
    w = np.zeros(x.width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        g = weight * (_sigmoid(x.dot(w[:-1]) + w[-1]) - y)
        grad = np.append(x.back(g) + penalty * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def calibrate(scores: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float = 0.1) -> np.ndarray:
    """Coefficients (last: constant) of a logistic model of few columns, by damped Newton steps."""
    a = np.column_stack([scores, np.ones(len(y))])
    weight = weight / weight.mean()
    c = np.zeros(a.shape[1])
    for _ in range(30):
        p = _sigmoid(a @ c)
        # The prior keeps separable scores finite and a view of little use small.
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + np.eye(len(c)) * prior
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - prior * c)
        c += step * min(1, 5 / (abs(step).max() + 1e-12))
    return c


@dataclass
class Model:
    text: np.ndarray
    page: np.ndarray
    text_cal: np.ndarray
    page_cal: np.ndarray
    both: np.ndarray

    def combine(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of each view and of both."""
        a, b = text * self.text_cal[0] + self.text_cal[1], page * self.page_cal[0] + self.page_cal[1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(a * self.both[0] + b * self.both[1] + self.both[2])


def co_train(text: Rows, page: Rows, y: np.ndarray, weight: np.ndarray, held: np.ndarray,
             rounds: int = 3, sure: float = 0.98, per_round: int = 400) -> Model:
    """y: 1, 0 or nan (pool); held: labelled rows kept for calibration."""
    known = ~np.isnan(y) & ~held
    views, labels = (text, page), [np.where(known, y, np.nan) for _ in range(2)]
    models, cals = [None, None], [None, None]
    for turn in range(rounds + 1):
        scores = []
        for i, x in enumerate(views):
            use = ~np.isnan(labels[i])
            target = labels[i][use]
            # Both classes weigh the same while fitting; calibration sets the odds.
            classes = np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum()))
            own = x.take(use)
            scale = ratios(own, target, classes) if i == 0 else np.ones(x.width)
            scale[x.width - (SHARES if i == 0 else 0):] = 1
            models[i] = fit(Rows(own.first, own.columns, own.values * scale.astype(np.float32)[own.columns], x.width), target, classes)
            models[i][:-1] *= scale
            raw = x.dot(models[i][:-1]) + models[i][-1]
            cals[i] = calibrate(raw[held][:, None], y[held], weight[held])
            scores.append(raw * cals[i][0] + cals[i][1])
        if turn < rounds:
            for i in range(2):
                p = _sigmoid(scores[1 - i])
                free = np.isnan(y) & np.isnan(labels[i])
                for label, conf in ((1.0, p), (0.0, 1 - p)):
                    best = np.flatnonzero(free & (conf >= sure))
                    labels[i][best[np.argsort(-conf[best], kind="stable")[:per_round]]] = label
    both = calibrate(np.column_stack(scores)[held], y[held], weight[held], 20.0)
    return Model(*models, *cals, both)


def _wanted(docs: DataFrame, labels: DataFrame, labelled: int, pool: int) -> pd.DataFrame:
    """doc_id, good, kind, total (labels of the kind) of a bounded sample; pool
    rows have no good."""
    known = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
             .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
             .withColumn("kind", F.expr("CASE WHEN quality = 0 THEN 'poor' WHEN toxic = 1 THEN 'toxic' ELSE 'good' END")))
    totals = {r["kind"]: r["count"] for r in known.groupBy("kind").count().collect()}
    draw = F.xxhash64(F.col("doc_id"), F.lit("co-training"))
    here = docs.select("doc_id").where("doc_id is not null").distinct()
    parts = [known.where(F.col("kind") == kind).join(here, "doc_id", "left_semi").orderBy(draw).limit(labelled).select("doc_id", "kind")
             for kind in totals]
    parts.append(here.join(known, "doc_id", "left_anti").orderBy(draw).limit(pool).select("doc_id", F.lit("pool").alias("kind")))
    ids = pd.concat([p.toArrow().to_pandas() for p in parts]).sort_values("doc_id")
    ids["good"] = ids.kind.map({"good": 1.0, "toxic": 0.0, "poor": 0.0, "pool": np.nan})
    ids["total"] = ids.kind.map(totals).fillna(0)
    return ids


def _page(batch, at: int) -> tuple[list, list, list]:
    return tuple(batch.column(at + i).to_pylist() for i in range(3))


def _once(docs: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, int]:
    """docs' lang, source, n_chars, the given columns as k0, k1, .. and the text,
    which is not sent again where it is one of those; and the text's place."""
    named = [F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]
    own = [] if "text" in columns else ["text"]
    at = 3 + (columns.index("text") if "text" in columns else len(columns))
    return docs.select("lang", "source", F.col("n_chars").cast("long").alias("n_chars"), *named, *own), at


def train(docs: DataFrame, labels: DataFrame, labelled: int = 2000, pool: int = 3000, **options) -> Model | None:
    """The model of a sample of at most 3 * labelled + pool documents; None
    where the labels do not hold both classes (twenty of each)."""
    ids = _wanted(docs, labels, labelled, pool)
    counts = ids.groupby("kind").size()
    if counts.get("good", 0) < 20 or counts.get("toxic", 0) + counts.get("poor", 0) < 20:
        return None
    chosen = docs.sparkSession.createDataFrame([(int(i),) for i in ids.doc_id], "doc_id long")

    def read(batches):
        for batch in batches:
            for lo, hi, data, offsets in W.chunks(batch.column(1)):
                rows, columns, values, shares = text_features(data, offsets)
                cut = np.searchsorted(rows, np.arange(hi - lo + 1)).astype(np.int32)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(cut, pa.array(columns.astype(np.int32))),
                     pa.ListArray.from_arrays(cut, pa.array(values.astype(np.float32))),
                     pa.array(shares.astype(np.float32).tolist(), pa.list_(pa.float32())),
                     pa.array(page_columns(*_page(part, 2)).astype(np.int32).tolist(), pa.list_(pa.int32()))],
                    names=["doc_id", "columns", "amounts", "shares", "page"])

    # The ids are bounded by the sample's size, so they may be broadcast.
    got = (docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
              .join(F.broadcast(chosen), "doc_id", "left_semi")
              .mapInArrow(read, "doc_id long, columns array<int>, amounts array<float>, shares array<float>, page array<int>")
              .dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id"))
    sample = got.select(["doc_id"]).to_pandas().merge(ids, on="doc_id")
    n = len(sample)
    # Rows of the features: hashed columns, then the shares.
    columns, amounts = got["columns"].combine_chunks(), got["amounts"].combine_chunks()
    sizes = columns.value_lengths().to_numpy() + SHARES
    first = np.concatenate([[0], np.cumsum(sizes)])
    places = first[1:, None] - SHARES + np.arange(SHARES)
    hashed = np.ones(first[-1], bool)
    hashed[places] = False
    text = Rows(first, np.empty(first[-1], np.int32), np.empty(first[-1], np.float32), (1 << TEXT_BITS) + SHARES)
    text.columns[hashed], text.values[hashed] = columns.flatten().to_numpy(), amounts.flatten().to_numpy()
    text.columns[places] = (1 << TEXT_BITS) + np.arange(SHARES)
    text.values[places] = got["shares"].combine_chunks().flatten().to_numpy().reshape(n, SHARES)
    page = Rows(np.arange(0, 4 * n + 1, 4), got["page"].combine_chunks().flatten().to_numpy(), np.ones(4 * n, np.float32), 1 << PAGE_BITS)
    y = sample.good.to_numpy(float)
    weight = (sample.total / sample.kind.map(counts)).to_numpy(float)
    # Every third labelled document of a kind is held out.
    turn = sample.groupby("kind").cumcount().to_numpy()
    return co_train(text, page, y, weight, ~np.isnan(y) & (turn % 3 == 0), **options)


def classify(docs: DataFrame, model: Model | None, columns: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """The given columns of every row, text_score, page_score, score, kept.

    Null texts are empty, null metadata is a value of its own; repeated rows
    each give a row.  Without a model all scores are null and all rows kept.
    """
    named = [F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]
    if model is None:
        return docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)], *[
            F.lit(None).cast("double").alias(c) for c in ("text_score", "page_score", "score")], F.lit(True).alias("kept"))
    rows, place = _once(docs, columns)
    schema = docs.select(*named).schema
    for c in ("text_score", "page_score", "score"):
        schema = schema.add(c, "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        for batch in batches:
            for lo, hi, data, offsets in W.chunks(batch.column(place)):
                part = batch.slice(lo, hi - lo)
                at, cols, values, shares = text_features(data, offsets)
                text = np.bincount(at, values * model.text[cols], hi - lo) + shares @ model.text[-1 - SHARES:-1] + model.text[-1]
                page = model.page[:-1][page_columns(*_page(part, 0))].sum(axis=1) + model.page[-1]
                scores = model.combine(text, page)
                yield pa.RecordBatch.from_arrays(part.columns[3:3 + len(columns)] + [pa.array(s) for s in scores], names=schema.names)

    return rows.mapInArrow(score, schema).withColumn("kept", F.col("score") >= threshold)


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """One row per row of docs: doc_id, text_score, page_score, score, kept.

    Scores are probabilities of good quality without toxicity.
    """
    return classify(docs, train(docs, labels, **options), threshold=threshold).withColumnRenamed("k0", "doc_id")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs that the classifier does not reject."""
    out = classify(docs, train(docs, labels, **options), tuple(docs.columns), threshold).where("kept")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
