"""Importance resampling towards a target distribution (operator 13).

Features are the runs of 1 to ``grams`` consecutive words of a text; a
feature's bucket is the CRC-32 of its words, joined by one space, modulo
``buckets``.  Buckets are counted over all texts and over all target texts, a
bucket's gain is the scaled log ratio of both, a text's weight the sum of its
features' gains, and the texts of the highest weight plus Gumbel noise (drawn
from the id) are the resample.

How words become buckets: a dictionary of words, each held between two
delimiters, is an Aho-Corasick automaton whose payloads are the word's CRC and
length.  One scan of a chunk of texts emits the payloads of its words in
order; the CRC of a run of words is composed of its words' payloads (a CRC of
a concatenation is linear in its parts), so no feature's text is ever built.
Stretches of text between two emitted words hold words that the dictionary
lacks; their payloads are computed directly, and they join the dictionary up
to ``MAX_WORDS`` words (per Python worker, kept from task to task).  Buckets
are the same whatever the dictionary holds.

1. A map scans every text once and writes its buckets, two or four bytes each.
2. Counts are dense sums per task, added up (``buckets`` numbers a task).
3. A map over the written buckets sums the gains.
4. Rows are ranked by score with range partitions and their counts.

Results for odd rows: every input row gives one row, also rows with an equal or
null id (the noise of a null id is that of an empty one).  A null text has no
words.  A text without features weighs 0.  Of equal scores the lesser id goes
first, then the row of fewer features.  With no eligible text nothing is
drawn, with an empty target all t are 0, and an empty table gives an empty
result.  Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softcluster.functions.kernels import partial_sums
from softcluster.functions.ranking import number_rows
from softcluster.llm import words as W
from softcluster.llm.tables import written

#: Words that a worker's automaton holds at most.
MAX_WORDS = 40_000
#: A longer word is not worth its states.
MAX_LETTERS = 40
CHUNK = 1 << 21


# --- CRC-32 of concatenations -----------------------------------------------

def _shift_tables(bits: int = 32) -> np.ndarray:
    """(bits, 4, 256): byte tables of "append 2**i zero bytes" on a CRC register."""
    single = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    # A byte's CRC is table[byte ^ 255] ^ 0xFF000000, for the register starts and ends inverted.
    table = single[np.arange(256) ^ 255] ^ np.uint32(0xFF000000)

    def appended(x: np.ndarray) -> np.ndarray:
        return table[x & np.uint32(255)] ^ (x >> np.uint32(8))

    columns = appended(np.uint32(1) << np.arange(32, dtype=np.uint32))
    out = np.zeros((bits, 4, 256), np.uint32)
    for i in range(bits):
        if i:
            columns = shifted(columns, out[i - 1])
        for byte in range(4):
            for bit in range(8):
                has = (np.arange(256) >> bit) & 1 == 1
                out[i, byte, has] ^= columns[8 * byte + bit]
    return out


def shifted(x: np.ndarray, tables: np.ndarray) -> np.ndarray:
    out = tables[0][x & np.uint32(255)]
    for byte in (1, 2, 3):
        out = out ^ tables[byte][(x >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


_tables = None


def crc_concat(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of A + B by those of A and of B and the length of B."""
    global _tables
    if _tables is None:
        _tables = _shift_tables()
    out = first.copy()
    for i in range(int(length.max(initial=0)).bit_length()):
        has = (length >> i) & 1 == 1
        out[has] = shifted(out[has], _tables[i])
    return out ^ second


# --- The dictionary -----------------------------------------------------------

class Dictionary:
    """An automaton over delimiter-bounded words with (CRC, length) payloads.

    Words are held as their UTF-8 bytes, one character each, so positions are
    byte positions and no text has to be valid.
    """

    def __init__(self, max_words: int = MAX_WORDS):
        self.max_words = max_words
        self.payload: dict[str, int] = {}
        self.automaton = None
        self.missed = 0

    @staticmethod
    def _payload(word: str) -> int:
        raw = word.encode("latin-1")
        return zlib.crc32(raw) | len(raw) << 32

    def _learn(self, words) -> None:
        for word in sorted(words):
            if len(self.payload) >= self.max_words:
                break
            if len(word) <= MAX_LETTERS:
                self.payload.setdefault(word, self._payload(word))
        self.automaton = ahocorasick.Automaton()
        for word, payload in self.payload.items():
            self.automaton.add_word(f" {word} ", (payload, len(word) + 1))
        if self.payload:
            self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Payloads of all words of a text that begins and ends with a
        delimiter, in order, and the position of each word's first byte."""
        if self.automaton is None or (self.missed > 1000 and len(self.payload) < self.max_words):
            # A rebuild reads as much text as it takes to miss the next words, so few are made.
            self._learn(set(text.split(" ")) - {""})
            self.missed = 0
        payloads, starts = [], []
        end = 0  # the delimiter that ends the word before
        fresh: dict[str, int] = {}

        def between(a: int, b: int) -> None:
            """The words in text[a:b], which the dictionary lacks."""
            at = a
            for word in text[a:b].split(" "):
                if word:
                    if word not in fresh:
                        fresh[word] = self._payload(word)
                    payloads.append(fresh[word])
                    starts.append(at)
                at += len(word) + 1

        for last, (payload, back) in self.automaton.iter(text) if self.payload else ():
            first = last - back
            if first > end:
                between(end, first)
            payloads.append(payload)
            starts.append(first + 1)
            end = last
        if end < len(text) - 1:
            between(end, len(text))
        self.missed += len(fresh)
        return np.array(payloads, np.int64), np.array(starts, np.int64)


_dictionary = Dictionary()


def features(data: np.ndarray, offsets: np.ndarray, grams: int, dictionary: Dictionary
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRCs of all features, their row, words per row) of a chunk of rows' bytes."""
    n = len(offsets) - 1
    # One delimiter before the first row and after each: runs of words end there.
    low = W.LOWER[data]
    low[~W.ALNUM[low]] = 32
    row = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.full(len(low) + n + 1, 32, np.uint8)
    padded[np.arange(len(low)) + row + 1] = low
    payload, starts = dictionary.scan(padded.tobytes().decode("latin-1"))
    row = np.searchsorted(offsets[1:] + np.arange(1, n + 1), starts, "right")
    crc, length = (payload & 0xFFFFFFFF).astype(np.uint32), payload >> 32
    count = np.bincount(row, minlength=n)
    out, rows = [crc], [row]
    run = crc
    space = np.uint32(zlib.crc32(b" "))
    for g in range(2, grams + 1):
        same = row[g - 1:] == row[:len(row) - g + 1]
        spaced = crc_concat(np.full(len(crc) - g + 1, space), crc[g - 1:], length[g - 1:])
        run = crc_concat(run[:len(crc) - g + 1], spaced, length[g - 1:] + 1)
        out.append(run[same])
        rows.append(row[g - 1:][same])
    return np.concatenate(out), np.concatenate(rows), count


def bucketed(docs: DataFrame, buckets: int, grams: int, max_words: int = MAX_WORDS) -> DataFrame:
    """id, n_words, n_features and the features' buckets (little-endian) of every row."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches):
        global _dictionary
        if _dictionary.max_words != max_words:
            _dictionary = Dictionary(max_words)
        for batch in batches:
            for lo, hi, data, offsets in W.chunks(batch.column(1), CHUNK):
                crc, row, count = features(data, offsets, grams, _dictionary)
                order = np.argsort(row, kind="stable")
                sizes = np.bincount(row, minlength=hi - lo)
                raw = (crc[order] % np.uint32(buckets)).astype(kind).tobytes()
                ends = np.concatenate([[0], np.cumsum(sizes * kind.itemsize)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(count), pa.array(sizes),
                     pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())],
                    names=["doc_id", "n_words", "n_features", "buckets"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, buckets binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _values(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All rows' buckets, and the rows' offsets among them."""
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]].view(kind), (offsets - offsets[0]) // kind.itemsize


def bucket_counts(bucketed_docs: DataFrame, buckets: int) -> np.ndarray:
    """The number of features in each bucket, over all rows."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def batch(b):
        return np.bincount(_values(b.column(0), kind)[0], minlength=buckets).astype(np.float64)[None]

    return partial_sums(bucketed_docs.select("buckets"), (1, buckets), batch)[0]


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the source)), each count and bucket plus one."""
    s, t, n = source, target, float(len(source))
    return np.array([math.floor(1000 * math.log((b + 1) * (s.sum() + n) / ((a + 1) * (t.sum() + n))))
                     for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weights(bucketed_docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of a row's gains."""
    kind = np.dtype("<u2" if len(gains) <= 1 << 16 else "<u4")
    shared = bucketed_docs.sparkSession.sparkContext.broadcast(gains)  # ``buckets`` numbers

    def run(batches):
        for batch in batches:
            values, offsets = _values(batch.column(3), kind)
            total = np.concatenate([[0], np.cumsum(shared.value[values])])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(total[offsets[1:]] - total[offsets[:-1]])],
                names=["doc_id", "n_words", "n_features", "weight"])

    ids = bucketed_docs.schema["doc_id"].dataType.simpleString()
    return (bucketed_docs.select("doc_id", "n_words", "n_features", "buckets")
            .mapInArrow(run, f"doc_id {ids}, n_words long, n_features long, weight long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, grams: int = 1,
             least_words: int = 20, seed: int = 2024, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn).

    ``target`` has texts in column text.  Of the texts of ``least_words`` words
    or more, ``percent`` in a hundred are drawn.
    """
    aim = target.select(F.lit(0).alias("doc_id"), "text")
    source = written(bucketed(docs, buckets, grams, max_words), "resample-buckets")
    gains = bucket_gains(bucket_counts(source, buckets), bucket_counts(bucketed(aim, buckets, grams, max_words), buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    scored = weights(source, gains).withColumn(
        "score", F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0))))
    scored = written(scored, "resample-scores")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("n_words")]
    eligible = F.col("n_words") >= least_words
    ranked = number_rows(scored.where(eligible), order, "rank")
    drawn = scored.where(eligible).count() * percent // 100
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1).cast("long")
    rest = scored.where(~eligible).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).unionByName(rest)
