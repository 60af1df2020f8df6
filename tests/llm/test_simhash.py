"""SimHash near-duplicates against all pairs, and its edge cases."""

import random

import xxhash
from pyspark.sql import functions as F

from softcluster.llm import simhash
from softcluster.llm.components import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def slow_components(rows):
    fps = [f for _, f in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(rows))]


def test_matches_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    want = slow_components(rows)
    assert got == {d: (f"{f:016x}", c) for (d, f), c in zip(rows, want)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None, "x"), (2, "", None), (3, "one two", "x"), (3, "one two", "x"), (None, "ONE  two", "x"),
            (None, "alone", "x"), (4, long, "x"), (5, long.upper(), "x"), (6, " \t\n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([("1", 1), ("2", 1), ("6", 1), ("3", 3), ("3", 3), ("None", 3), ("None", None), ("4", 4), ("5", 4)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]
    empty = docs.where("false")
    assert simhash.near_duplicates(empty).collect() == [] and simhash.keep_one(empty).collect() == []


def test_links_are_exact_in_dense_lists(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    # 4,000 fingerprints within two bytes of one another: one list of that length.
    fps = list({base ^ x for x in rng.sample(range(1 << 16), 4000)}) + [rng.getrandbits(64) for _ in range(500)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {frozenset((a & (1 << 64) - 1, b & (1 << 64) - 1)) for a, b in simhash.links(df).collect()}
    known = set(fps)
    flips = [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    assert got == {frozenset((f, f ^ x)) for f in fps for x in flips if f ^ x in known}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [
        (5000, x) for x in range(5001, 5400)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {x: find(x) for x in list(root)}
    assert components(df.where(F.lit(False))).collect() == []
