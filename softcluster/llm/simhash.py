"""SimHash near-duplicates over a byte-position inverted index (operator 4).

A fingerprint within ``max_bits`` of another differs in at most that many of
its eight bytes, so the two agree in at least 8 - max_bits positional bytes.
One posting list per single (position, byte) would hold a 256th of all rows,
and tallying those pairs is quadratic.  The index is therefore keyed by the
bytes at every choice of 8 - max_bits positions: a pair that reaches the
guaranteed count meets in at least one such list, and lists hold little else.
In a list, the positional bytes that a pair shares are tallied, pairs that
reach the count are kept, and the differing bits are verified.

Members of one list are distinct fingerprints that differ in max_bits given
bytes only, so a list has at most 256**max_bits members whatever the input;
within a long list partners are looked up by their bit flips instead of
trying all pairs.  Equal texts meet in one fingerprint before the index.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softcluster.llm.components import components
from softcluster.llm.tables import written

LONG_LIST = 512


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit j is set if over half the word shingles' XXH64 (seed 42) have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends + 1 - size)[:len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:].tolist())),
                    np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, columns: list[str], shingle: int = 3, text: str = "text") -> DataFrame:
    """The given columns and ``fp``, the fingerprint of ``text`` as a signed long.
    A text that is one of the columns is sent once."""
    schema = docs.select(*columns).schema.add("fp", "long")
    own = text in columns
    sent = docs.select(*columns, *([] if own else [F.col(text).alias("fp")]))
    at, n = columns.index(text) if own else len(columns), len(columns)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays(batch.columns[:n] + [pa.array(fps.view(np.int64))],
                                             names=[*columns, "fp"])

    return sent.mapInArrow(run, schema)


def _pairs(fps: np.ndarray, keys: np.ndarray, masks: np.ndarray, max_bits: int):
    """Linked pairs of rows sorted by key; masks: the free bits of each row's list."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    long_runs = [(a, b) for a, b in zip(edges[:-1], edges[1:]) if b - a > LONG_LIST] \
        if len(edges) > 1 and np.diff(edges).max(initial=0) > LONG_LIST else []
    short = np.ones(len(keys), bool)
    for a, b in long_runs:
        short[a:b] = False
        run = np.sort(fps[a:b])
        free = [j for j in range(64) if int(masks[a]) >> j & 1]
        for n in range(1, max_bits + 1):
            for flip in combinations(free, n):
                other = run ^ np.uint64(sum(1 << j for j in flip))
                at = np.minimum(np.searchsorted(run, other), len(run) - 1)
                hit = (run[at] == other) & (run < other)
                yield run[hit], other[hit]
    live = np.flatnonzero(short)
    for d in range(1, LONG_LIST):
        live = live[live + d < len(keys)]
        live = live[keys[live] == keys[live + d]]
        if not len(live):
            break
        yield fps[live], fps[live + d]


def links(fingerprints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs a, b of distinct fingerprints (column ``fp``) at most max_bits apart."""
    if not 0 < max_bits < 8:
        raise ValueError("max_bits must be 1 to 7")
    least = 8 - max_bits
    masks = [sum(0xFF << 8 * p for p in ps) for ps in combinations(range(8), least)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    lists = F.array(*[F.struct(F.lit(i).cast("short").alias("ps"),
                               F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))).alias("key"))
                      for i, m in enumerate(signed)])
    rows = (fingerprints.select("fp", F.explode(lists).alias("x")).select("x.key", "x.ps", "fp")
            .repartition("key").sortWithinPartitions("key", "fp"))

    def run(batches):
        free = ~np.array(masks, np.uint64)
        left = None
        for batch, last in _with_last(batches):
            key, ps, fp = (np.asarray(batch.column(i)) for i in range(3))
            fp = fp.view(np.uint64)
            if left is not None:
                key, ps, fp = (np.concatenate(x) for x in zip(left, (key, ps, fp)))
            left = None
            if not last and len(key):  # the last list may go on in the next batch
                cut = int(np.searchsorted(key, key[-1]))
                left = key[cut:], ps[cut:], fp[cut:]
                key, ps, fp = key[:cut], ps[:cut], fp[:cut]
            for a, b in _pairs(fp, key, free[ps], max_bits):
                differ = a ^ b
                shared = (differ.astype("<u8").view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
                ok = (shared >= least) & (np.bitwise_count(differ) <= max_bits) & (differ > 0)
                if ok.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a[ok].view(np.int64)), pa.array(b[ok].view(np.int64))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _with_last(batches):
    """Each batch, and whether it is the last."""
    held = None
    for batch in batches:
        if held is not None:
            yield held, False
        held = batch
    if held is not None:
        yield held, True


def groups(rows: DataFrame, max_bits: int = 2) -> DataFrame:
    """Each distinct ``fp`` of rows (doc_id, fp): root, component_id.

    root is the component's least fingerprint, component_id its least doc_id
    (null if all are null).
    """
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    linked = components(links(fps, max_bits)).withColumnRenamed("node", "fp")
    placed = fps.join(linked, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return placed.select("fp", "root").join(least, "root")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id.

    Fingerprints link at max_bits or fewer differing bits; component_id is the
    least doc_id that links reach, the row's own included.  Null or blank
    texts have fingerprint zero and link like any other; rows with a null
    doc_id take part and never name a component; repeated rows each give a
    row.  Further columns of docs are ignored.
    """
    rows = written(with_fingerprint(docs, ["doc_id"], shingle), "simhash")
    return rows.join(groups(rows, max_bits), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """docs with one row of each component: of the least doc_id (nulls last),
    then the least row in the order of the written table."""
    columns = docs.columns
    numbered = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], "doc_id")
    kept = [f"c{i}" for i in range(len(columns))]
    rows = written(
        with_fingerprint(numbered, [*kept, "doc_id"], shingle, kept[columns.index("text")])
        .withColumn("row", F.monotonically_increasing_id()), "simhash")
    placed = rows.select("row", "doc_id", "fp").join(groups(rows.select("doc_id", "fp"), max_bits), "fp")
    first = placed.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row").alias("r"))).alias("x"))
    return rows.join(first.select(F.col("x.r").alias("row")), "row", "left_semi").select(
        *[F.col(k).alias(c) for k, c in zip(kept, columns)])
