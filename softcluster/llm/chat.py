"""Chat formatting by token-level assembly (operator 5).

Each turn is encoded in three separate segments (marker, role, text) and the
segments are spliced with reserved ids beyond the tokenizer's vocabulary, so a
text can never produce a marker:  TURN role BODY text END.  Control strings
that occur in a text are escaped all the same, since the formatted text may be
encoded again by others.  Which tokens count for the loss follows from prefix
sums: +1 where an assistant's text begins, -1 where it ends.

Turns are encoded where they lie, before the shuffle that brings each
conversation's turns together; after it rows stream in order, so a
conversation of any length needs the memory of one batch.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TURN, BODY, END = 0, 1, 2  # reserved ids, counted from the vocabulary's size
MARKERS = ("<|turn|>", "<|body|>", "<|end|>\n")

#: Control strings of chat templates in use; none begins within another.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
            *(m.strip() for m in MARKERS))
ESCAPE = "\\"

_ANY = re.compile("|".join(f"{re.escape(c[0])}{re.escape(ESCAPE)}*{re.escape(c[1:])}" for c in CONTROLS))
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}{re.escape(ESCAPE)}+{re.escape(c[1:])}" for c in CONTROLS))


def escape(text: str) -> str:
    """Puts one more escape sign into every control string, plain or escaped."""
    return _ANY.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


class Codec:
    """A byte-level tokenizer of whole Unicode texts, and its reserved ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.first = self.tokenizer.get_vocab_size()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def assemble(conversations: DataFrame, tokenizer_path: str, loss_role: str = "assistant") -> DataFrame:
    """One row per turn: conv_id, n (its place, from 0), start (its first
    token's place in the conversation), ids, mask.

    Turns go by turn, nulls first, ties by role and text; repeated rows are
    turns of their own.  Null roles and texts are empty; rows of a null
    conv_id are one conversation.
    """
    id_type = conversations.schema["conv_id"].dataType.simpleString()

    def encode(batches):
        tool = codec(tokenizer_path)
        for batch in batches:
            role, text = (["" if x is None else x for x in batch.column(i).to_pylist()] for i in (2, 3))
            segments = [tool.encode([escape(x) for x in xs]) for xs in (role, text)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(s, pa.list_(pa.int32())) for s in segments)],
                names=["conv_id", "turn", "role", "text", "role_ids", "text_ids"])

    turn_type = conversations.schema["turn"].dataType.simpleString()
    encoded = conversations.select("conv_id", "turn", "role", "text").mapInArrow(
        encode, f"conv_id {id_type}, turn {turn_type}, role string, text string, role_ids array<int>, text_ids array<int>")
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id", "role", "role_ids", "text_ids")

    def splice(batches):
        first, at, now, any_yet = codec(tokenizer_path).first, (0, 0), None, False
        turn, body, end = (np.array([first + x], np.int32) for x in (TURN, BODY, END))
        for batch in batches:
            convs = batch.column(0).to_pylist()
            rows, opens, closes, sizes = [], [], [], []
            total = 0
            for role, a, b in zip(batch.column(1).to_pylist(), *(
                    [np.asarray(x.values, np.int32) for x in batch.column(i)] for i in (2, 3))):
                if role == loss_role:
                    opens.append(total + len(a) + 2)
                    closes.append(total + len(a) + 2 + len(b))
                rows += [turn, a, body, b, end]
                sizes.append(len(a) + len(b) + 3)
                total += sizes[-1]
            change = np.zeros(total + 1, np.int32)
            np.add.at(change, opens, 1)
            np.add.at(change, closes, -1)
            mask = np.cumsum(change)[:-1].astype(np.int8)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            places, starts = [], []
            for conv, size in zip(convs, sizes):
                if not any_yet or conv != now:
                    at, now, any_yet = (0, 0), conv, True
                places.append(at[0])
                starts.append(at[1])
                at = at[0] + 1, at[1] + size
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(places, pa.int64()), pa.array(starts, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(mask))], names=["conv_id", "n", "start", "ids", "mask"])

    return ordered.mapInArrow(splice, f"conv_id {id_type}, n long, start long, ids array<int>, mask array<tinyint>")


def read_back(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per conversation of assemble()'s rows: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Everything comes from ids and mask: turns by splitting at reserved ids,
    the loss text by decoding masked tokens, both unescaped.  Digests run on
    as rows stream by, so conversations of any length need no memory.
    """
    id_type = formatted.schema["conv_id"].dataType.simpleString()
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "n").select("conv_id", "ids", "mask")
    schema = (f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

    def run(batches):
        tool = codec(tokenizer_path)
        first, now = tool.first, None
        for batch in batches:
            done, segments = [], []
            for ids, mask in zip(*([np.asarray(x.values) for x in batch.column(i)] for i in (1, 2))):
                reserved = np.flatnonzero(ids >= first)
                if (ids[reserved] - first).tolist() != [TURN, BODY, END] or reserved[0] != 0 or reserved[2] != len(ids) - 1:
                    raise ValueError("a row is not one turn")
                body = reserved[1]
                segments += [ids[1:body].tolist(), ids[body + 1:-1].tolist(), ids[mask > 0].tolist()]
            texts = tool.decode(segments)
            for i, conv in enumerate(batch.column(0).to_pylist()):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, loss = texts[3 * i:3 * i + 3]
                plain = unescape(loss)
                now[1] += 1
                now[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                now[3] += len(plain)
                now[4].update(plain.encode())
                now[5] += sum(map(len, MARKERS)) + len(role) + len(text)
            if done:
                yield _digests(done, batch.schema.field(0).type)
        if now is not None:
            yield _digests([now], batch.schema.field(0).type)

    return rows.mapInArrow(run, schema)


def _digests(done, id_type):
    return pa.RecordBatch.from_arrays(
        [pa.array([d[0] for d in done], id_type), pa.array([d[1] for d in done], pa.int64()),
         pa.array([d[2].hexdigest() for d in done]), pa.array([d[3] for d in done], pa.int64()),
         pa.array([d[4].hexdigest() for d in done]), pa.array([d[5] for d in done], pa.int64())],
        names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def render(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """conv_id, n, text: each turn's tokens as text, markers and all."""
    id_type = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        tool = codec(tokenizer_path)
        for batch in batches:
            out = []
            for ids in batch.column(2):
                ids = np.asarray(ids.values)
                body = int(np.flatnonzero(ids == tool.first + BODY)[0])
                role, text = tool.decode([ids[1:body].tolist(), ids[body + 1:-1].tolist()])
                out.append(MARKERS[0] + role + MARKERS[1] + text + MARKERS[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["conv_id", "n", "text"])

    return formatted.select("conv_id", "n", "ids").mapInArrow(run, f"conv_id {id_type}, n long, text string")
