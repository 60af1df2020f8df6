"""Importance resampling against plain counts over zlib's CRC-32."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from softcluster.llm import queries
from softcluster.llm import resampling as R
from softcluster.llm import words as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text, grams, n):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i:i + g]).encode()) % n
                   for g in range(1, grams + 1) for i in range(len(words) - g + 1)]


def expected(rows, target, percent=10, n=10_000, grams=1, least=20, seed=2024):
    docs = [(i, *buckets(t, grams, n)) for i, t in rows]
    s = Counter(b for _, _, f in docs for b in f)
    t = Counter(b for x in target for b in buckets(x, grams, n)[1])
    s_all, t_all = float(sum(s.values())), float(sum(t.values()))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + n) / ((s[b] + 1) * (t_all + n)))) for b in s}
    out = []
    for i, words, f in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    eligible = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[1]))
    for rank, r in enumerate(eligible[:len(eligible) * percent // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=repr)


def run(spark, rows, target, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = R.resample(docs, aim, **kw)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, got.collect()), key=repr)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "Δέλτα", "naïve", "x1", "42", "漢字", "long" * 20] + [f"w{i}" for i in range(200)]
    return [rng.choice(["", " ", "\n"]) + rng.choice([" ", "  ", ", ", "-", "\x00", "\xa0"]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))
            for _ in range(n)]


@pytest.mark.parametrize("kw", [{}, {"grams": 3, "buckets": 97, "percent": 50}, {"grams": 2, "buckets": 100_000, "least_words": 5, "max_words": 50},
                                {"max_words": 0}])
def test_against_plain_counts(spark, kw):
    rows, target = list(enumerate(texts(1, 150))), texts(2, 20)
    plain = {"n" if k == "buckets" else "least" if k == "least_words" else k: v for k, v in kw.items() if k != "max_words"}
    assert run(spark, rows, target, **kw) == expected(rows, target, **plain)


def test_odd_rows(spark):
    many = " ".join(f"t{i}" for i in range(25))
    rows = [(1, None), (2, ""), (3, "..."), (4, many), (4, many), (4, many + " more"), (None, many), (5, "a" * 3_000_000), (6, "b c " * 300_000)]
    assert run(spark, rows, [many, None], percent=60) == expected(rows, [many, None], percent=60)
    assert run(spark, rows, [], percent=60) == expected(rows, [], percent=60)
    assert run(spark, [], [many]) == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 30, 3, 4, "x", 1.0)], "doc_id long, text string, rank int, n_words int, buckets string, weight double")
    aim = spark.createDataFrame([("word", 1)], "text string, buckets int")
    assert [r["n_words"] for r in R.resample(docs, aim, percent=100).collect()] == [30]


def test_crc_of_concatenations():
    rng = np.random.default_rng(3)
    parts = [rng.bytes(int(n)) for n in rng.integers(0, 400, 200)]
    a, b = parts[:100], parts[100:]
    got = R.crc_concat(np.array([zlib.crc32(x) for x in a], np.uint32), np.array([zlib.crc32(x) for x in b], np.uint32),
                       np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


def test_dictionary_does_not_matter():
    import pyarrow as pa
    chunk = W.flat(pa.array(texts(4, 50)))
    every = R.features(*chunk, 2, R.Dictionary())
    small, none = R.Dictionary(5), R.Dictionary(0)
    for d in (small, none):
        assert all(np.array_equal(x, y) for x, y in zip(every, R.features(*chunk, 2, d)))
    assert len(small.payload) == 5 and not none.payload
    again = R.Dictionary()
    R.features(*W.flat(pa.array(texts(5, 50))), 1, again)
    assert all(np.array_equal(x, y) for x, y in zip(every, R.features(*chunk, 2, again)))


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    got = queries.QUERIES["op13_resample"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((r[0], *r[2:]) for r in expected(docs, target)), key=repr)
