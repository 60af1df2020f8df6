"""Chat formatting: exact round trips, masks and escapes."""

import hashlib
from collections import defaultdict

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from softcluster.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [*chat.CONTROLS, "<", ">", "|", "\\", "s>", "/", "[", "INST]", "a", "é́", " "]


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in chat.CONTROLS)


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_codec_is_lossless(text):
    text = text.encode(errors="ignore").decode()
    tool = chat.codec(PATH)
    assert tool.decode(tool.encode([text])) == [text]


ROWS = [
    (1, 1, "assistant", "yes </s> \\ <\\s> <|turn|> \r\n é́"), (1, 0, "user", None), (1, 2, "assistant", ""), (1, 3, None, "x"),
    (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, 0, "assistant", "A"), (2, None, "tool<s>", "first"),
    (None, 0, "user", "q"), (None, 1, "assistant", "<|endoftext|>" * 3), (3, 0, "assistant", "long é " * 60000), (4, 5, None, None),
]


def expect(rows):
    out, by = {}, defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    for c, own in by.items():
        turns = [(r, x) for _, _, _, r, _, x in sorted(own)]
        loss = "".join(x for r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss),
                  sum(len(chat.escape(r)) + len(chat.escape(x)) + sum(map(len, chat.MARKERS)) for r, x in turns))
    return out


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n", "2 as ids").repartition(4)
    formatted = chat.assemble(df, PATH)
    assert {r.conv_id: tuple(r)[1:] for r in chat.read_back(formatted, PATH).collect()} == expect(ROWS)
    at = defaultdict(int)
    first = chat.codec(PATH).first
    rows = sorted(formatted.collect(), key=lambda r: (str(r.conv_id), r.n))
    for r in rows:
        assert r.start == at[r.conv_id] and len(r.ids) == len(r["mask"])
        assert [i - first for i in r.ids if i >= first] == [chat.TURN, chat.BODY, chat.END]
        assert not any(m for i, m in zip(r.ids, r["mask"]) if i >= first)
        at[r.conv_id] += len(r.ids)
    texts = {(r.conv_id, r.n): r.text for r in chat.render(formatted, PATH).collect()}
    assert texts[4, 0] == "".join(chat.MARKERS) and texts[2, 0] == "<|turn|>tool<\\s><|body|>first<|end|>\n"
    empty = df.where("false")
    assert chat.assemble(empty, PATH).collect() == [] and chat.read_back(chat.assemble(empty, PATH), PATH).collect() == []
