"""Line deduplication (operator 12), in DataFrame functions alone.

A text is split at line feeds.  A line's key is the line without ASCII white
space at both ends, A-Z lower-cased.  Keys that many documents hold lose all
their lines in every document; the other lines stay in their order.

1. Each text becomes a row of its lines' key digests, written once.
2. The distinct digests of each row are exploded, and documents are counted
   per digest with partial counts before the shuffle.
3. All digests are exploded with their positions and matched with those over
   the threshold.  Up to ``broadcast_keys`` of them are broadcast.  Beyond,
   only the most frequent ones are, so that no key is hot in the join that
   matches the rest.
4. Dropped positions come together per text, and the text's lines between
   them are put together again.

Results for odd rows: every input row is a document and gives one row, also
rows with an equal or null id; a row that stands there twice counts as two
documents.  A null or empty text is one empty line.  An empty table gives an
empty result.  Texts are keyed by a 128-bit hash of id and text, so a row's
result depends on nothing but its content and the counts.  Other columns of
the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from softcluster.llm.tables import written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digests of lines that a broadcast may hold (32 bytes each).
BROADCAST_KEYS = 1 << 17


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """The line stripped and lower-cased; translate() is slow, and lower() the same on ASCII."""
    ascii_only = F.length(line) == F.octet_length(line)
    return F.btrim(F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER)), F.lit(SPACE))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("r1"),
                       F.xxhash64(F.lit(1), "doc_id", text).alias("r2"))


def digests(rows: DataFrame, least_chars: int = 1) -> DataFrame:
    """r1, r2, digests: the MD5 digest of every line's key, null for keys of fewer code points."""
    def digest(line: Column) -> Column:
        key = _key(line)
        return F.when(F.length(key) >= least_chars, F.md5(key))

    return rows.select("r1", "r2", F.transform(_split(F.col("text")), digest).alias("digests"))


def frequent_keys(digests: DataFrame, least_documents: int = 10) -> DataFrame:
    """digest, n: keys that at least ``least_documents`` documents hold, with their number."""
    # Distinct per text before the explode: a document counts once per key.
    return (digests.select(F.explode(F.array_distinct("digests")).alias("digest")).where("digest is not null")
            .groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_documents))


def _dropped(digests: DataFrame, frequent: DataFrame, broadcast_keys: int) -> DataFrame:
    """r1, r2, at: the sorted positions of the lines that a text loses."""
    lines = digests.select("r1", "r2", F.posexplode("digests").alias("at", "digest")).where("digest is not null")
    if frequent.count() <= broadcast_keys:
        lost = lines.join(F.broadcast(frequent.select("digest")), "digest", "left_semi")
    else:
        # At most 1/broadcast_keys of all rows share a key beyond these.
        top = F.broadcast(frequent.orderBy(F.desc("n"), "digest").limit(broadcast_keys).select("digest"))
        rest = lines.join(top, "digest", "left_anti").join(frequent.select("digest").hint("merge"), "digest", "left_semi")
        lost = lines.join(top, "digest", "left_semi").unionByName(rest)
    return lost.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("at")).alias("at"))


def line_dedup(docs: DataFrame, least_documents: int = 10, least_chars: int = 1,
               broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped and text (the kept lines)."""
    rows = _rows(docs)
    keys = written(digests(rows, least_chars), "line-digests")
    frequent = written(frequent_keys(keys, least_documents), "line-keys")
    # A table of its own, so that the join below may be broadcast or its hot texts split.
    lost = written(_dropped(keys, frequent, broadcast_keys), "line-drops")
    return (rows.join(lost, ["r1", "r2"], "left")
            .withColumn("lines", _split(F.col("text")))
            .select("doc_id", F.size("lines").cast("long").alias("n_lines"),
                    F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped"),
                    F.when(F.col("at").isNull(), F.col("text")).otherwise(_kept()).alias("text")))


def _kept() -> Column:
    """The lines between dropped positions, joined: one slice per gap."""
    def gap(j: Column) -> Column:
        first = F.when(j == 0, F.lit(0)).otherwise(F.get("at", j - 1) + 1)
        end = F.coalesce(F.get("at", j), F.size("lines"))
        return F.slice("lines", first + 1, end - first)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("at")), gap)), "\n")
