"""Decontamination against a scan of every window, and its edge cases."""

import re

from softcluster.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, window):
    out = []
    grams = [(i, tuple(w[s:s + min(window, len(w))])) for i, t in items if i is not None
             for w in [words(t)] if w for s in range(len(w) - min(window, len(w)) + 1)]
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for i, g in grams:
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s:s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    found.add(str(i))
        out.append((doc, len(w), len(hit), len(found), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, items, window=10, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(d, b, window, **kw).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in got],
                  key=str) == slow(docs, items, window)


def test_matches_a_scan(spark):
    import random
    rng = random.Random(3)
    vocabulary = ["la", "le", "Été", "x1", "straße", "b", "日本"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "\n", "."]) for _ in range(n))
    docs = [(i, text(rng.randrange(120))) for i in range(60)]
    items = [(i, text(rng.randrange(9))) for i in range(40)]
    check(spark, docs, items, window=4)
    check(spark, docs, items, window=4, log2_bits=8)  # a bitmap that lets nearly all through
    check(spark, docs, items, window=3, shingle=2)


def test_edge_rows(spark):
    ten = "a b c d e f g h i j"
    docs = [(1, None), (2, ""), (3, ten + " k"), (3, ten + " k"), (None, ten), (4, "A, B; c D e F g H i J! " * 3000), (5, "one"), (6, "---")]
    check(spark, docs, [(1, ten + " k l"), (2, "one"), (2, "one"), (3, None), (4, ""), (None, "one")])
    check(spark, docs, [])
    check(spark, [], [(1, ten)])
