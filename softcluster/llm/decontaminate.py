"""Benchmark decontamination by a prefix-filtered set join (operator 3).

Every window of ``window`` consecutive item words is a set of word shingles
that a document passage must contain in full.  Shingles are ordered by rarity
in the documents; at full containment the prefix that a passage cannot do
without is the one rarest shingle of the window.  Documents' shingles are
joined with those prefixes alone.  A match fixes where the window would lie,
so the positional bound (its start and end inside the document's words)
prunes it, and the words themselves decide.

Both passes over the documents are numpy on Arrow buffers.  A fixed-size
bitmap of the benchmark's shingles lets only shingles through that may occur
in it; the joins are on the full values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softcluster.llm import words as W
from softcluster.llm.tables import bitmap, in_bitmap, written


def item_windows(items: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """item_id, text (the window's words, space-joined), n, key and at: each
    shingle of the window and its place.  Items of fewer words are one window."""

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for lo, hi, data, offsets in W.chunks(batch.column(1)):
                data = W.LOWER[data]
                starts, ends, first = W.spans(data, offsets, W.ALNUM)
                h = W.hashes(data, starts, ends)
                raw = data.tobytes()
                word = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
                for row in range(lo, hi):
                    a, b = int(first[row - lo]), int(first[row - lo + 1])
                    n = min(window, b - a)
                    for s in range(a, b - n + 1 if n else a):
                        key = W.shingles(h[s:s + n], min(shingle, n)).view(np.int64)
                        out += [(ids[row], " ".join(word[s:s + n]), n, int(k), at) for at, k in enumerate(key)]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(schema.names, r)) for r in out], schema=schema)

    item_type = items.schema["item_id"].dataType.simpleString()
    schema = pa.schema([("item_id", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_type]),
                        ("window", pa.string()), ("n", pa.int32()), ("key", pa.int64()), ("at", pa.int32())])
    return items.select("item_id", "text").mapInArrow(
        run, f"item_id {item_type}, window string, n int, key long, at int")


def _found(lo, hi, data, offsets, bits, sizes):
    """Rows, positions and keys of the chunk's shingles that the bitmap lets through."""
    starts, ends, first = W.spans(data, offsets, W.ALNUM)
    h = W.hashes(data, starts, ends)
    row_of = np.repeat(np.arange(hi - lo), np.diff(first))
    for n in sizes:
        key = W.shingles(h, n)
        at = np.flatnonzero(in_bitmap(bits, key))
        at = at[at + n <= first[row_of[at] + 1]]
        yield row_of[at], at, key[at].view(np.int64)
    yield starts, ends, first


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3,
                  log2_bits: int = 24, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items (the ids
    as sorted strings), contaminated, row (unique), and the columns of ``keep``
    as k0, k1, ...

    A document word inside any occurrence of an item's window is hit.  Null
    and blank texts have no words and no hits; items without words, or with a
    null id, have no window (a null id's text is not matched).  Repeated rows
    of docs each give a row, repeated items count once.
    """
    sc = docs.sparkSession.sparkContext
    windows = written(item_windows(items.where("item_id is not null"), window, shingle).distinct(), "item_windows")
    sizes = sorted(r[0] for r in windows.select(F.least(F.lit(shingle), "n")).distinct().collect())
    shared = sc.broadcast(bitmap(windows, "key", log2_bits))

    def count(batches):
        for batch in batches:
            for lo, hi, data, offsets in W.chunks(batch.column(0)):
                parts = list(_found(lo, hi, W.LOWER[data], offsets, shared.value, sizes))[:-1]
                if parts:
                    key, n = np.unique(np.concatenate([p[2] for p in parts]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    rarity = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("f"))
    # A window with a shingle that no document holds cannot occur.
    ranked = (windows.join(rarity, "key", "left")
              .groupBy("item_id", "window", "n")
              .agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "key", "at")).alias("p")))
    prefixes = written(ranked.where("p.f > 0").select(
        "item_id", "window", F.col("n").alias("len"), F.col("p.key").alias("key"), F.col("p.at").alias("at")), "prefixes")
    prefix_bits = sc.broadcast(bitmap(prefixes, "key", log2_bits))
    around = window - 1

    def match(batches):
        for batch in batches:
            for lo, hi, data, offsets in W.chunks(batch.column(place)):
                data = W.LOWER[data]
                *parts, (starts, ends, first) = _found(lo, hi, data, offsets, prefix_bits.value, sizes)
                raw = data.tobytes()
                got = [[] for _ in range(hi - lo)]
                for rows, at, keys in parts:
                    # Words on both sides, as far as any window may reach.
                    a = np.maximum(at - around, first[rows])
                    b = np.minimum(at + window, first[rows + 1])
                    for r, p, k, x, y in zip(rows.tolist(), (at - first[rows]).tolist(), keys.tolist(),
                                             a.tolist(), b.tolist()):
                        got[r].append({"key": k, "pos": p, "from": x - int(first[r]),
                                       "words": [raw[s:e].decode() for s, e in
                                                 zip(starts[x:y].tolist(), ends[x:y].tolist())]})
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[skip:], pa.array(np.diff(first)), pa.array(got, found)], names=schema.names)

    found = pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int64()), ("from", pa.int64()),
                                ("words", pa.list_(pa.string()))]))
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    # A text that is kept is sent once.
    own = [] if "text" in keep else ["text"]
    skip, place = 1 + len(own), 1 + (keep.index("text") if "text" in keep else 0)
    schema = docs.select("doc_id", *kept).schema.add("n_words", "long").add(
        "found", T.DataType.fromDDL("array<struct<key:long,pos:long,from:long,words:array<string>>>"))
    rows = written(docs.select("doc_id", *own, *kept).mapInArrow(match, schema)
                   .withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    seen = rows.where("size(found) > 0").select("row", "n_words", F.explode("found").alias("x")).select("row", "n_words", "x.*")
    hits = (seen.join(prefixes, "key")
            .withColumn("start", F.col("pos") - F.col("at"))
            .where("start >= 0 and start + len <= n_words")
            .where("concat_ws(' ', slice(words, cast(start - `from` as int) + 1, len)) = window")
            .select("row", "item_id", "start", (F.col("start") + F.col("len")).alias("end")).distinct())
    items_hit = (hits.select("row", F.col("item_id").cast("string").alias("item")).distinct()
                 .groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items")))
    ends = hits.groupBy("row", "start").agg(F.max("end").alias("end"))
    reach = F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    covered = (ends.withColumn("reach", F.coalesce(reach, F.lit(0)))
               .groupBy("row").agg(F.sum(F.expr("greatest(end - greatest(start, reach), 0)")).alias("n_hit")))
    return (rows.drop("found").join(covered, "row", "left").join(items_hit, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "row",
                    *[f"k{i}" for i in range(len(keep))]))


def keep_clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no window of an item."""
    out = decontaminate(docs, items, keep=tuple(docs.columns), **options).where("not contaminated")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
