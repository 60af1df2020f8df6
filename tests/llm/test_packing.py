"""Packing: exact ids, gapless windows, proportions; edge cases."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from softcluster.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check(tokenizer, docs, rows, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, text in docs.items():
        want, got = ids_of(tokenizer, text), []
        for r in sorted(by_doc.pop(doc), key=lambda r: r.start):
            assert r.start == len(got) and r.doc_tokens == len(want)
            ids = np.frombuffer(bytes(r.ids), "<u4")
            assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
            got += ids.tolist()
        assert got == want
    assert not by_doc
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, own in by_sequence.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window if s < len(by_sequence) - 1 else 0 < at <= window


def test_packs_the_documents(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    rows = packing.pack(docs, PATH, quantum=64).collect()
    check(tokenizer, {r.doc_id: r.text for r in docs.collect()}, rows, 2048)
    # Deficits are carried on: up to any window, no source strays from its share by
    # more than a round's credit and what other queues' unserved credits shift.
    total, by, shares = sum(r.length for r in rows), defaultdict(int), defaultdict(int)
    for r in rows:
        by[r.sequence_id, r.queue] += r.length
        shares[r.queue] += r.length / total
    last = max(r.sequence_id for r in rows)
    for q, p in shares.items():
        had = 0
        for s in range(last):
            had += by[s, q]
            assert abs(had - 2048 * (s + 1) * p) <= 2048 * p * (1 + len(shares) * 64 / 2048) + 64 + 1


def test_weights_and_the_shared_queue(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(docs, PATH, weights={"src1": 3.0, "src2": 1.0}, quantum=32).collect()
    check(tokenizer, texts, rows, 2048)
    first = defaultdict(int)
    for r in rows:
        if r.sequence_id == 0:
            first[r.queue] += r.length
    assert abs(first["src1"] - 1536) <= 64 and abs(first["src2"] - 512) <= 64
    check(tokenizer, texts, packing.pack(docs, PATH, lanes=4, window=512).collect(), 512)
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, weights={"none": 1.0})


def test_encoder_matches_the_tokenizer(tokenizer):
    import random
    import pyarrow as pa
    rng = random.Random(9)
    signs = ["'", "'s", "'t", "'re", "!", "-", "\x01", " ", "\n", ".", ",", "a", "bc", "S", "1", "23", "é", "\u0301", "日", "_", "<|", "\x1c", "İ", "\xa0", "\u3000"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["", "<|endoftext|>x", "a<|ENDOFTEXT|>"]
    encoder = packing.Encoder(PATH)
    for part in (texts[:1000], texts[1000:], texts):
        ids, cuts = encoder.encode(*packing.W.flat(pa.array(part)))
        for i, t in enumerate(part):
            assert ids[cuts[i]:cuts[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_edge_rows(spark, tokenizer):
    odd = "Don't we'll É́ é İ ΑΣ, x.y,, ... a b\x1cc 日本語。123 <|startoftext|> <|STARTOFTEXT|> a.\n.b, c,"
    docs = {1: None, 2: "", 3: odd, 4: odd * 900, 5: "a", 6: " \n\t "}
    df = spark.createDataFrame([(i, t, None if i % 2 else "s", 1) for i, t in docs.items()],
                               "doc_id long, text string, source string, start long").repartition(3)
    check(tokenizer, docs, packing.pack(df, PATH, quantum=16, window=128).collect(), 128)
    assert packing.pack(df.where("false"), PATH).collect() == []
    twice = packing.pack(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string"), PATH, queue=None).collect()
    assert sorted((r.start, r.length, r.sequence_id, r.offset) for r in twice) == [(0, 3, 0, 0), (0, 3, 0, 3)]


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_long_words_that_collide_as_polynomials(tokenizer):
    """Two words of 1,024 letters whose polynomial hashes are equal, in one chunk and in two."""
    import pyarrow as pa
    words = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    flat = packing.W.flat(pa.array([" ".join(words)]))
    starts, ends = np.array([0, 1025]), np.array([1024, 2049])
    assert len(set(packing.W.hashes(flat[0], starts, ends).tolist())) == 1
    assert len(set(packing.W.checked_hashes(flat[0], starts, ends).tolist())) == 2
    one, two = packing.Encoder(PATH), packing.Encoder(PATH)
    for encoder, parts in ((one, [list(words)]), (two, [[w] for w in words])):
        for part in parts:
            ids, cuts = encoder.encode(*packing.W.flat(pa.array(part)))
            assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [ids_of(tokenizer, w)[:-1] for w in part]


def test_pieces_of_one_hash_are_encoded_by_themselves(tokenizer, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(packing.W, "checked_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    texts = ["some words of few lengths, e.g. these", "and others, don't they", "", "é 漢字 words", "some words"]
    encoder = packing.Encoder(PATH)
    for part in (texts[:2], texts[2:], texts):
        ids, cuts = encoder.encode(*packing.W.flat(pa.array(part)))
        for i, t in enumerate(part):
            assert ids[cuts[i]:cuts[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_three_thousand_sources_hold_their_shares(spark, tokenizer):
    """Every source has its part of every run of windows, the smallest one by its weight."""
    rows = [(i, "word " * 40, f"s{i % 3000}") for i in range(9000)] + [(9000 + i, "tiny " * 30, "least") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = packing.pack(df, PATH, window=512, quantum=8, lanes=100).collect()
    check(tokenizer, {r[0]: r[1] for r in rows}, got, 512)
    half, total = defaultdict(int), defaultdict(int)
    last = max(r.sequence_id for r in got)
    for r in got:
        total[r.queue] += r.length
        half[r.queue] += r.length if r.sequence_id <= last // 2 else 0
    assert all(0.25 < half[q] / total[q] < 0.75 for q in total)
    weights = {f"s{i}": 1.0 for i in range(3000)} | {"least": 1000.0}
    first = [r for r in packing.pack(df, PATH, weights=weights, window=512, quantum=8, lanes=100).collect() if r.sequence_id == 0]
    least = sum(r.length for r in first if r.queue == "least")
    assert least >= min(62, 512 // 4 - 16)
