"""Mixture-controlled packing by deficit round-robin (operator 7).

Each source is a queue of its documents' ids, end to end.  In every round a
source earns credit in proportion to its target share of a window and is
served as many whole blocks of ``quantum`` ids as its credit covers (its last,
shorter block when its credit covers that); what is left over is its deficit
and goes on to the next round.  The rounds' ids, end to end, are cut into
windows of ``window`` ids, so every window but the last is full.

Since credits are proportional to the round number, the round and place of a
block follow from its number and the queues' sizes.  So no task waits for
another's deficits: one pass tokenizes and counts, the counts give each task's
start in each queue, and one more pass places every piece.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Sequence
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from softcluster.functions.ranking import number_rows
from softcluster.llm import words as W
from softcluster.llm.tables import written

#: Credits are kept in fractions of an id of this many bits.
FRACTION = 16
#: Pieces that a worker remembers at most.
MEMO = 3_000_000
#: Documents whose ids a task cuts at once.
ROWS = 1000

_LETTERS = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz"))
_SIGNS = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"))


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of lower-cased texts' runs between white space, and each
    row's first; runs are cut between a-z and ASCII signs but apostrophes."""
    solid, letter, sign = W.SOLID[data], _LETTERS[data], _SIGNS[data]
    opens, closes = solid.copy(), solid.copy()
    inner = solid[1:] & solid[:-1] & ~(letter[1:] & sign[:-1] | sign[1:] & letter[:-1])
    inner[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))] - 1] = False
    opens[1:] &= ~inner
    closes[:-1] &= ~inner
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def _one_word(piece: str) -> bool:
    if piece.isascii():
        return piece.isalpha() or not any(map(str.isalnum, piece)) and "'" not in piece and piece.isprintable()
    return piece.isalpha() and piece.lower() == piece and is_normalized("NFC", piece)


def _appended(pool: np.ndarray, used: int, new: np.ndarray) -> tuple[np.ndarray, int]:
    """A pool with ``new`` after its used part, grown if it must, and how much is used."""
    if used + len(new) > len(pool):
        pool = np.concatenate([pool[:used], np.zeros(used + 2 * len(new), pool.dtype)])
    pool[used:used + len(new)] = new
    return pool, used + len(new)


class Encoder:
    """Ids of texts, for a tokenizer that lower-cases, drops white space, never
    joins pieces across it and parts letters from signs.

    A piece between white space is encoded once and remembered by a 64-bit
    hash and its bytes.  Every occurrence is compared with the remembered
    bytes; one of other bytes and the same hash is encoded by itself.  Special
    tokens are found before lower-casing, so texts that may hold one are
    encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted; the others in the same order
        self.first = np.zeros(0, np.int64)  # of the piece's ids in the pool
        self.sizes = np.zeros(0, np.int32)
        self.begin = np.zeros(0, np.int64)  # of its bytes in the text
        self.lengths = np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.text, self.written = np.zeros(1 << 18, np.uint8), 0

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Remembers pieces.  A piece of letters, or of signs, alone is one word
        to the tokenizer and has one id that ends a word, so many of them are
        encoded as one text and parted by it; others go one by one."""
        raw, pieces = pieces, [p.decode() for p in pieces]
        one = np.fromiter((_one_word(p) for p in pieces), bool, len(pieces)) if self.ends.any() else np.zeros(len(pieces), bool)
        words, rest = np.flatnonzero(one), np.flatnonzero(~one)
        texts = [" ".join(pieces[i] for i in words[k:k + 1000].tolist()) for k in range(0, len(words), 1000)]
        ids = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(sizes) != len(words):  # it parts some word: one by one
            words, rest = np.zeros(0, np.int64), np.arange(len(pieces))
            ids, sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast([pieces[i] for i in rest.tolist()], add_special_tokens=False)]
        order = np.concatenate([words, rest])
        back = np.argsort(order)
        ids = np.concatenate([ids, *odd])
        sizes = np.concatenate([sizes, np.fromiter(map(len, odd), np.int64, len(odd))])
        first = self.used + np.cumsum(sizes) - sizes
        self._keep(keys, raw, ids, first[back], sizes[back].astype(np.int32))

    def _keep(self, keys, raw, ids, first, sizes) -> None:
        self.pool, self.used = _appended(self.pool, self.used, ids)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        begin = self.written + np.cumsum(lengths) - lengths
        self.text, self.written = _appended(self.text, self.written, np.frombuffer(b"".join(raw), np.uint8))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.sizes, self.begin, self.lengths = (
            np.insert(old, at, new) for old, new in
            ((self.keys, keys), (self.first, first), (self.sizes, sizes), (self.begin, begin), (self.lengths, lengths)))

    def _same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Which occurrences have the bytes of their slot's piece."""
        n = ends - starts
        same = n == self.lengths[slot]
        own = np.flatnonzero(same)
        for part in np.array_split(own, max(1, int(n[own].sum()) >> 22)):  # some MB of bytes at a time
            many = n[part]
            inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            differ = data[np.repeat(starts[part], many) + inside] != self.text[np.repeat(self.begin[slot[part]], many) + inside]
            same[np.repeat(part, many)[differ]] = False
        return same

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids end to end, and where each row's begin (and the end)."""
        raw = data.tobytes()
        special = {r: self.ids(raw[a:b].decode()) for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
                   if raw.find(b"<|", a, b) >= 0} if b"<|" in raw else {}
        low = W.LOWER[data]
        starts, ends, first = _pieces(low, offsets)
        keys, at, where = np.unique(W.checked_hashes(low, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > MEMO:
            self._forget()
        slot = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[slot] != keys) if len(self.keys) else np.arange(len(keys))
        text = low.tobytes()
        if len(new):
            self._learn(keys[new], [text[x:y] for x, y in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
            slot = np.searchsorted(self.keys, keys)
        pool, begin, n = self.pool, self.first[slot][where], self.sizes[slot][where].astype(np.int64)
        other = np.flatnonzero(~self._same(low, starts, ends, slot[where]))
        if len(other):  # pieces of a hash that another piece has
            own = [np.array(self.ids(text[x:y].decode()), np.uint32) for x, y in zip(starts[other].tolist(), ends[other].tolist())]
            n[other] = [len(x) for x in own]
            begin[other] = self.used + np.cumsum(n[other]) - n[other]
            pool = np.concatenate([pool[:self.used], *own])
        if special:
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            n[np.isin(row, list(special))] = 0
        ends_at = np.cumsum(n)
        ids = pool[np.repeat(begin - (ends_at - n), n) + np.arange(ends_at[-1] if len(n) else 0)]
        cuts = np.concatenate([[0], ends_at])[first]
        if special:
            rows = [special[r] if r in special else ids[cuts[r]:cuts[r + 1]] for r in range(len(offsets) - 1)]
            ids = np.concatenate([np.asarray(x, np.uint32) for x in rows])
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        return ids, cuts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenized(docs: DataFrame, path: str, end_id: int, queue: str | None) -> DataFrame:
    """doc_id, queue, ids (binary), n, task and start: the ids of the same queue
    before the document in its task."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", (F.lit("") if queue is None else F.coalesce(F.col(queue).cast("string"), F.lit(""))).alias("queue"))

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        task, at = TaskContext.get().partitionId(), {}
        for batch in batches:
            for lo, hi, data, offsets in W.chunks(batch.column(1), 1 << 20):
                ids, cuts = encoder(path).encode(data, offsets)
                n = np.diff(cuts) + 1
                every = np.insert(ids, cuts[1:], np.uint32(end_id)).astype("<u4")
                starts, part = [], batch.slice(lo, hi - lo)
                for q, m in zip(part.column(2).to_pylist(), n.tolist()):
                    starts.append(at.get(q, 0))
                    at[q] = starts[-1] + m
                ends = np.concatenate([[0], np.cumsum(n)]) * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2),
                     pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(every)]).cast(pa.binary()),
                     pa.array(n), pa.array(np.full(len(n), task, np.int32)), pa.array(starts, pa.int64())],
                    names=["doc_id", "queue", "ids", "n", "task", "start"])

    return rows.mapInArrow(run, f"doc_id {doc_type}, queue string, ids binary, n long, task int, start long")


class Schedule:
    """Where each queue's blocks go; sizes and credits per queue as arrays."""

    def __init__(self, sizes: Sequence[int], shares: Sequence[float], window: int, quantum: int):
        self.sizes = np.array(sizes, np.int64)
        total = float(sum(shares))
        self.credit = np.maximum(1, np.array([int(window * s / total * (1 << FRACTION)) for s in shares], np.int64))
        self.quantum = quantum
        self.rounds = -(-(self.sizes << FRACTION) // self.credit)

    def served(self, r: np.ndarray) -> np.ndarray:
        """Ids served of each queue (columns) by the end of rounds r (rows)."""
        r = np.minimum(r[:, None], self.rounds)
        earned = (r * self.credit) >> FRACTION
        return np.where(earned >= self.sizes, self.sizes, earned // self.quantum * self.quantum)

    def places(self, q: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The place in the whole order of block j of queue q."""
        ends = np.minimum((j + 1) * self.quantum, self.sizes[q])
        rounds, back = np.unique(-(-(ends << FRACTION) // self.credit[q]), return_inverse=True)
        out = np.empty(len(j), np.int64)
        # A table of rounds by queues, some rounds at a time.
        step = max(1, (1 << 21) // len(self.sizes))
        for i in range(0, len(rounds), step):
            before, after = self.served(rounds[i:i + step] - 1), self.served(rounds[i:i + step])
            ahead = np.cumsum(after - before, axis=1) - (after - before) + before.sum(axis=1)[:, None] - before
            own = np.flatnonzero((back >= i) & (back < i + step))
            out[own] = ahead[back[own] - i, q[own]]
        return out + j * self.quantum


class Lanes:
    """Schedules of any number of queues, in two levels.

    The first queues have a lane of their own; when there are more than
    ``lanes``, the later ones share the second half of the lanes, dealt in turn.
    Deficit round-robin serves the lanes by the sums of their queues' shares,
    and inside a shared lane its queues by theirs.
    """

    def __init__(self, sizes: np.ndarray, shares: np.ndarray, window: int, quantum: int, lanes: int):
        q = np.arange(len(sizes))
        own = len(q) if len(q) <= lanes else lanes // 2
        self.lane = np.where(q < own, q, own + (q - own) % max(1, lanes - own))
        self.index = np.where(q < own, 0, (q - own) // max(1, lanes - own))
        self.shared = own
        self.top = Schedule(np.bincount(self.lane, sizes).astype(np.int64) if len(q) else sizes, np.bincount(self.lane, shares), window, quantum)
        # A lane whose queues have no share serves them by their sizes.
        self.inner = {}
        for l in range(own, len(self.top.sizes)):
            of = q[q >= own][(q[q >= own] - own) % max(1, lanes - own) == l - own]
            self.inner[l] = Schedule(sizes[of], shares[of] if shares[of].sum() > 0 else sizes[of], window, quantum)

    def runs(self, q: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, start in it, place in the whole order, length) of runs of ids."""
        doc, inside, lane, place, length = np.arange(len(n)), np.zeros(len(n), np.int64), self.lane[q], start, n
        parts = [(x[lane < self.shared] for x in (doc, inside, lane, place, length))]
        for l in np.unique(lane[lane >= self.shared]).tolist():
            at = np.flatnonzero(lane == l)
            own, begin, where, size = runs(self.inner[l], self.index[q[at]], start[at], n[at])
            parts.append((at[own], begin, np.full(len(own), l), where, size))
        doc, inside, lane, place, length = (np.concatenate(x) for x in zip(*parts))
        own, begin, where, size = runs(self.top, lane, place, length)
        order = np.lexsort((inside[own] + begin, doc[own]))
        return doc[own][order], (inside[own] + begin)[order], where[order], size[order]


def runs(schedule: Schedule, q: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(number, start in it, place in the whole order, length) of the runs that
    stretches of ids at start .. start + n in their queues q fall into."""
    k = schedule.quantum
    first = start // k
    count = (start + n - 1) // k + 1 - first
    own = np.repeat(np.arange(len(n)), count)
    j = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + first[own]
    begin = np.maximum(j * k, start[own])
    length = np.minimum((j + 1) * k, start[own] + n[own]) - begin
    return own, begin - start[own], schedule.places(q[own], j) + begin - j * k, length


def pieces(lanes: Lanes, q: np.ndarray, start: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(document, start in it, length, sequence, offset) of every piece of
    documents whose ids lie at start .. start + n in their queues q."""
    doc, begin, place, length = lanes.runs(q, start, n)
    # Cut at the windows' borders.
    parts = (place + length - 1) // window - place // window + 1
    own = np.repeat(np.arange(len(place)), parts)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
    sequence = place[own] // window + nth
    at = np.maximum(sequence * window, place[own])
    to = np.minimum((sequence + 1) * window, place[own] + length[own])
    doc, inside = doc[own], begin[own] + at - place[own]
    # Neighbours that follow one another in document and window are one piece.
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sequence[1:] != sequence[:-1]) | (at[1:] != to[:-1])
    head = np.flatnonzero(new)
    total = np.add.reduceat(to - at, head) if len(head) else head
    return doc[head], inside[head], total, sequence[head], at[head] - sequence[head] * window


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, queue: str | None = "source",
         weights: dict[str, float] | None = None, quantum: int = 256, lanes: int = 1000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, queue, ids (binary).

    A document's ids are its text's and end_id; null texts are empty.  Pieces
    lie gapless in sequences of ``window`` ids; the last one may be shorter.
    ``weights`` are target proportions by queue (missing ones: 0, served as
    slowly as credits allow); by default each queue's share of all ids, so all
    queues run dry together.  Every queue is served by its own share: up to
    ``lanes`` queues directly; of more, the first half as many directly (the
    largest, or those with weights), and the others in lanes of several queues,
    which have a schedule of their own.  The schedules take 16 bytes per queue.  A null queue is the
    empty one.  Repeated rows are packed each; no rows give no pieces.
    """
    spark = docs.sparkSession
    rows = written(tokenized(docs, tokenizer_path, end_id, queue), "tokens")
    sums = written(rows.groupBy("queue", "task").agg(F.sum("n").alias("n")), "queue_sums")
    queues = sums.groupBy("queue").agg(F.sum("n").alias("n")).withColumn("share", F.col("n").cast("double"))
    if weights is not None:
        given = spark.createDataFrame([(q, float(w)) for q, w in weights.items()], "queue string, share double")
        queues = queues.drop("share").join(given, "queue", "left").fillna(0.0, ["share"])
    numbered = number_rows(queues, [*([F.desc("share")] if weights is not None else []), F.desc("n"), F.col("queue")], "q")
    table = numbered.select("q", "n", "share").orderBy("q").toArrow()
    sizes, shares = table["n"].to_numpy(), table["share"].to_numpy()
    if weights is not None and len(sizes) and not shares.sum() > 0:
        raise ValueError("weights name no queue of the documents")
    shared = spark.sparkContext.broadcast(Lanes(sizes, shares, window, quantum, lanes)) if len(sizes) else None

    base = F.sum("n").over(Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    # Written, so that its size is known when the join with all rows is planned.
    bases = written(sums.select("queue", "task", base.alias("base")).join(numbered.select("queue", "q"), "queue"), "queue_bases")
    placed = rows.join(bases, ["queue", "task"]).select("doc_id", "queue", "ids", "n", (F.col("start") + F.col("base")).alias("start"), "q")
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            n, start, q = (batch.column(i).to_numpy() for i in (3, 4, 5))
            ids = batch.column(2).to_pylist()
            doc, at, length, sequence, offset = pieces(shared.value, q, start, n, window)
            parts = [ids[d][4 * a:4 * (a + m)] for d, a, m in zip(doc.tolist(), at.tolist(), length.tolist())]
            owner = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner), pa.array(at), pa.array(length), pa.array(list(map(zlib.crc32, parts)), pa.int64()),
                 pa.array(n[doc]), pa.array(sequence), pa.array(offset), batch.column(1).take(owner), pa.array(parts, pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "ids"])

    return placed.mapInArrow(run, f"doc_id {doc_type}, start long, length long, ids_crc32 long, doc_tokens long, "
                                  "sequence_id long, offset long, queue string, ids binary")
