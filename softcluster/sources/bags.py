"""Bag-of-words source (A2): documents -> term_counts(doc_id, term_id, cnt).

Tokens are maximal runs of letters of any script, lower-cased, taken from the
WHOLE text.  Every word is in the vocabulary unless the caller names a bound;
term ids 0..V-1 go by document frequency, ties by the word.

Whole texts are dealt by document id into blocks of a bounded size.  A task
counts the words of its block's documents by codes of its own, so that words
travel once per (block, word), never per (document, word): frequencies are
summed over the blocks' lists of words, ids come from a range-partitioned sort,
each partition counting on from the rows before it, and a cogroup hands every
block the ids of its codes.  Documents are packed into runs (``operators/packed``)
as soon as they are counted and stay so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import number_rows
from ..operators.blocks import Blocks, block_of, in_blocks
from ..operators.packed import Runs, lists, numbers, pack, runs, unpack
from ..session import NARROW, cut_lineage

TOKEN_PATTERN = r"\p{L}+"
#: Bytes of text that a block holds about.
BLOCK_BYTES = 96 << 20
#: Entries of a packed run, or one document's.
BATCH_ENTRIES = 1 << 20
CODED = "part int, run binary, base int, words array<string>, freqs array<int>"
CODED_SCHEMA = pa.schema([("part", pa.int32()), ("run", pa.binary()), ("base", pa.int32()), ("words", pa.list_(pa.string())),
                          ("freqs", pa.list_(pa.int32()))])
BAG = "block int, doc_id long, terms array<int>, counts array<double>"


def _merged(ids: pa.Array, row: np.ndarray, code: np.ndarray, n: np.ndarray):
    """Rows of one id become one, and entries of one place are added up."""
    place = ids.dictionary_encode(null_encoding="encode")
    if len(place.dictionary) == len(ids):
        return ids, row, code, n
    row = numbers(place.indices)[row]
    order = np.lexsort((code, row))
    row, code, n = row[order], code[order], n[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))) if len(row) else row
    return place.dictionary, row[first], code[first], np.add.reduceat(n, first) if len(row) else n


def _packed(ids: pa.Array, row: np.ndarray, code: np.ndarray, n: np.ndarray):
    """(ids, packed rows) of runs of documents with entries, by rows in order."""
    sizes = np.bincount(row, minlength=len(ids))
    ends = np.cumsum(sizes)
    for s, e in runs(sizes, BATCH_ENTRIES):
        own = slice(int(ends[s] - sizes[s]), int(ends[e - 1]))
        batch = pa.RecordBatch.from_arrays([ids.slice(s, e - s), lists(code[own], sizes[s:e], pa.int32()), lists(n[own], sizes[s:e], pa.int32())],
                                           names=["doc_id", "codes", "counts"])
        batch = batch.filter(pa.array(sizes[s:e] > 0))
        if batch.num_rows:
            yield batch.column(0), pack(batch)


def _entries_of(run: bytes):
    """(ids, row, code, count) of a packed run."""
    t = unpack(run)
    code = t.column("codes").combine_chunks()
    return (t.column("doc_id").combine_chunks(), np.repeat(np.arange(t.num_rows), numbers(code.value_lengths())),
            numbers(code.flatten()), numbers(t.column("counts").combine_chunks().flatten()))


def _once(found: list):
    """The packed runs with every id in one row: rows of an id that comes again are merged."""
    if not found:
        return
    places = pa.concat_arrays([ids for ids, _ in found]).dictionary_encode(null_encoding="encode")
    if len(places.dictionary) == len(places):
        yield from (run for _, run in found)
        return
    place = numbers(places.indices)
    again, at, kept = np.bincount(place, minlength=len(places.dictionary)) > 1, 0, []
    for ids, run in found:
        more = again[place[at:at + len(ids)]]
        at += len(ids)
        if not more.any():
            yield run
            continue
        _, row, code, n = _entries_of(run)
        for which, put in ((more, kept.append), (~more, None)):
            some = which[row]
            part = ids.filter(pa.array(which)), (np.cumsum(which) - 1)[row[some]], code[some], n[some]
            if put:
                put(part)
            else:
                yield from (r for _, r in _packed(*part))
    before = np.cumsum([0, *(len(ids) for ids, *_ in kept)])
    merged = _merged(pa.concat_arrays([x[0] for x in kept]), np.concatenate([x[1] + b for x, b in zip(kept, before)]),
                     *(np.concatenate([x[i] for x in kept]) for i in (2, 3)))
    yield from (run for _, run in _packed(*merged))


def _encode(batches):
    """A block's documents (block, id, words) as packed codes and counts, then its words by code."""
    index: dict[str, int] = {}
    found, part = [], 0
    for b in batches:
        part = b.column(0)[0].as_py() if b.num_rows else part
        for s, e in runs(numbers(b.column(2).value_lengths().fill_null(0)), BATCH_ENTRIES):
            own = b.column(2).slice(s, e - s)
            words = own.flatten().dictionary_encode()
            row = np.repeat(np.arange(e - s), numbers(own.value_lengths().fill_null(0)))
            code = np.fromiter((index.setdefault(w, len(index)) for w in words.dictionary.to_pylist()), np.int32, len(words.dictionary))
            if len(code):  # a row's codes in order pack best
                key, n = np.unique(row * len(index) + code[numbers(words.indices)], return_counts=True)
                found += _packed(b.column(1).slice(s, e - s), (key // len(index)).astype(np.int64), (key % len(index)).astype(np.int32), n.astype(np.int32))
    freq = np.zeros(len(index), np.int64)

    def batch(**columns) -> pa.RecordBatch:
        columns["part"] = pa.array([part], pa.int32())
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(1, f.type)) for f in CODED_SCHEMA], names=CODED_SCHEMA.names)

    for run in _once(found):
        freq += np.bincount(_entries_of(run)[2], minlength=len(index))
        yield batch(run=pa.array([run], pa.binary()))
    words, freq = list(index), freq.astype(np.int32)
    for s in range(0, len(words), 1 << 14):
        many = np.array([len(words[s:s + (1 << 14)])])
        yield batch(base=pa.array([s], pa.int32()), words=lists(words[s:s + (1 << 14)], many, pa.string()),
                    freqs=lists(freq[s:s + (1 << 14)], many, pa.int32()))


def coded_documents(documents: DataFrame, text: str = "text", doc_id: str = "doc_id"):
    """-> (part, run) and (of, code, word, n): each block's packed
    documents by the block's own codes, and its words with the documents that
    have them.  Written, so that the texts are read into words once."""
    coded, words, _ = _coded(documents, text, doc_id)
    return coded, words


def _coded(documents: DataFrame, text: str, doc_id: str):
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    found = F.transform(F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), F.lit(0)), lambda w: F.lower(w))
    n = max(NARROW, -(-size // BLOCK_BYTES))
    dealt = in_blocks(docs.withColumn("block", block_of(F.col("doc_id"), n)), n).select("block", "doc_id", found.alias("words"))
    coded = cut_lineage(dealt.mapInArrow(_encode, CODED))
    words = coded.where("base is not null").select("part", "base", F.posexplode(F.arrays_zip("words", "freqs")).alias("at", "w"))
    return (coded.where("base is null").select("part", "run"),
            words.select(F.col("part").alias("of"), (F.col("base") + F.col("at")).alias("code"), F.col("w.words").alias("word"), F.col("w.freqs").alias("n")),
            n)


def vocabulary(words: DataFrame, vocab_size: int | None = None) -> DataFrame:
    """(word, term_id INT, doc_freq) of (.., word, n) rows; document frequency =
    the sum of n.  All words, or the first ``vocab_size``."""
    freq = words.groupBy("word").agg(F.sum("n").alias("doc_freq"))
    out = number_rows(freq, [F.col("doc_freq").desc(), F.col("word")]).select(
        "word", F.col("position").cast("int").alias("term_id"), "doc_freq")
    return out if vocab_size is None else out.where(F.col("term_id") < vocab_size)


def _place(own: pa.Table, ids: pa.Table) -> pa.Table:
    """A block's packed documents with term ids for codes, terms rising."""
    out = [[], []]
    if own.num_rows and ids.num_rows:
        code_of = numbers(ids.column("code"))
        term_of = np.full(int(code_of.max()) + 1, -1, np.int32)
        term_of[code_of] = numbers(ids.column("term_id"))
        block = own.column("part")[0].as_py()
        for t in Runs(own.column("run")):
            code = t.column("codes").combine_chunks()
            row, code = np.repeat(np.arange(t.num_rows), numbers(code.value_lengths())), numbers(code.flatten())
            known = code < len(term_of)
            term, n = np.where(known, term_of[np.where(known, code, 0)], -1), numbers(t.column("counts").combine_chunks().flatten())
            if (term < 0).any():
                row, term, n = row[term >= 0], term[term >= 0], n[term >= 0]
            order = np.lexsort((term, row))
            sizes = np.bincount(row, minlength=t.num_rows)
            batch = pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), lists(term[order], sizes, pa.int32()),
                                                lists(n[order].astype(np.float64), sizes, pa.float64())], names=["doc_id", "terms", "counts"])
            batch = batch.filter(pa.array(sizes > 0))
            if batch.num_rows:
                out[0].append(block)
                out[1].append(pack(batch))
    return pa.table({"block": pa.array(out[0], pa.int32()), "run": pa.array(out[1], pa.binary())})


def bag_blocks(documents: DataFrame, vocab_size: int | None = None, text: str = "text",
               doc_id: str = "doc_id", vocab: DataFrame | None = None) -> tuple[Blocks, DataFrame]:
    """-> (blocks of (doc_id, terms, counts), vocabulary): one row per document
    with a word, terms rising; a document is in the block of its id."""
    coded, words, n = _coded(documents, text, doc_id)
    vocab = vocab if vocab is not None else vocabulary(words, vocab_size)
    ids = words.join(vocab.select("word", "term_id"), "word").select("of", "code", "term_id")
    packed = in_blocks(coded, n, "part").groupBy("part").cogroup(in_blocks(ids, n, "of").groupBy("of")).applyInArrow(_place, "block int, run binary")
    return Blocks.keep(packed, n, T.StructType.fromDDL(BAG), "terms"), vocab


def document_bags(documents: DataFrame, vocab_size: int | None = None, text: str = "text",
                  doc_id: str = "doc_id", vocab: DataFrame | None = None):
    """-> (bags(block, doc_id, terms, counts), vocabulary), the rows of ``bag_blocks``."""
    blocks, vocab = bag_blocks(documents, vocab_size, text, doc_id, vocab)
    return blocks.rows, vocab


def entries(bags: DataFrame) -> DataFrame:
    """(doc_id, term_id, cnt) of bags."""
    return bags.select("doc_id", F.explode(F.arrays_zip("terms", "counts")).alias("e")).select(
        "doc_id", F.col("e.terms").alias("term_id"), F.col("e.counts").alias("cnt"))


def term_counts(documents: DataFrame, vocab_size: int | None = None, text: str = "text",
                doc_id: str = "doc_id", vocab: DataFrame | None = None):
    """-> (term_counts(doc_id, term_id, cnt DOUBLE), vocabulary), the entries of ``document_bags``."""
    bags, vocab = document_bags(documents, vocab_size, text, doc_id, vocab)
    return entries(bags), vocab


def corpus_stats(term_counts_df: DataFrame) -> DataFrame:
    """Documents with a term, distinct terms, total token count."""
    return term_counts_df.agg(
        F.countDistinct("doc_id").alias("docs"),
        F.countDistinct("term_id").alias("terms"),
        F.sum("cnt").alias("tokens"))
