"""Line deduplication against a plain loop."""

import hashlib
import random
from collections import Counter

import pytest

from softcluster.llm import lines, queries


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def expected(texts, least_documents, least_chars=1):
    held = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    drop = {k for k, n in held.items() if n >= least_documents and len(k) >= least_chars}
    out = []
    for t in texts:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if key(x) not in drop]
        out.append((len(all_), len(all_) - len(kept), "\n".join(kept)))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in lines.line_dedup(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("broadcast_keys", [1 << 17, 1, 0])
def test_random_texts(spark, broadcast_keys):
    rng = random.Random(5)
    pool = ["Menu", " menu\t", "MENU ", "", "  ", "É", "é", "a b", "A B\r", "\x0bz\x0c", " menu", "unique %d", "x" * 5]
    texts = ["\n".join(rng.choice(pool).replace("%d", str(rng.random())) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    rows = list(enumerate(texts))
    for least in (1, 5, 20):
        want = sorted(((i, *e) for i, e in zip(range(60), expected(texts, least))), key=repr)
        assert run(spark, rows, least_documents=least, broadcast_keys=broadcast_keys) == want


def test_odd_rows(spark):
    texts = [None, "", "same", "same", "same", "\n", "\n\n x \n", "same\nsame\nother\n"]
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[2]), (3, texts[3]), (None, texts[4]), (None, texts[5]), (4, texts[6]), (5, texts[7])]
    want = sorted(((i, *e) for (i, _), e in zip(rows, expected(texts, 4))), key=repr)
    assert run(spark, rows, least_documents=4) == want
    assert run(spark, rows, least_documents=3, least_chars=0) == sorted(
        ((i, *e) for (i, _), e in zip(rows, expected(texts, 3, 0))), key=repr)
    assert run(spark, []) == []


def test_counts_documents_not_lines(spark):
    rows = [(1, "again\n" * 50), (2, "again"), (3, "once")]
    assert run(spark, rows, least_documents=3) == sorted([(1, 51, 0, "again\n" * 50), (2, 1, 0, "again"), (3, 1, 0, "once")], key=repr)


def test_long_text_and_clashing_columns(spark):
    text = "\n".join(["word " * 20, "drop me"] * 20_000) + "\n" + "y" * 2_000_000
    df = spark.createDataFrame([(i, t, 7, 8, "z", [1]) for i, t in enumerate([text] + ["drop me"] * 9)],
                               "doc_id long, text string, n long, h1 long, line string, at array<int>")
    got = {r["doc_id"]: r for r in lines.line_dedup(df).collect()}
    want = expected([text] + ["drop me"] * 9, 10)
    assert all((got[i]["n_lines"], got[i]["n_dropped"], got[i]["text"]) == w for i, w in enumerate(want))


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {(r["doc_id"], n, d, hashlib.sha256(t.encode()).hexdigest())
            for r, (n, d, t) in zip(docs, expected([r["text"] for r in docs], 10))}
    got = queries.QUERIES["op12_line_dedup"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert {tuple(r) for r in got.collect()} == want and any(d for _, _, d, _ in want)
