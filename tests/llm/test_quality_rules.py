"""Quality rules: counts against Python, outliers against numpy."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from softcluster.llm import quality_rules as Q


def slow_counts(text):
    text = text or ""
    split = lambda s: "".join(" " if c in Q.SPACE else c for c in s).split(" ")
    words = [w for w in split(text) if w]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if any(split(x))]
    return (len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered))


ODD = [None, "", " \n\t\n", "a", "a b", "a b c", "a b c a b c", "x x x x x", "é\U0001F600 | # \x0b\x0c\r日\xa0本\n\na\n a\na\n",
       "a b c d " * 20000, " ".join(f"w{i}" for i in range(30000)), "one\ntwo\none\ntwo\r\n" * 50]


def test_counts_match_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    both = docs.unionAll(odd).repartition(4)
    want = {r.doc_id: slow_counts(r.text) for r in both.collect()}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.counts(both, "doc_id").collect()}
    assert got == want
    full = both.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "row": F.lit(1), "x0": F.lit("t")})
    for r in Q.quality_rules(full).collect():
        n, chars, symbols, lines, repeat = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)


def test_edge_rows(spark):
    text = " ".join(f"w{i % 97}x{i}" for i in range(80))
    rows = [(1, text, None, None), (1, text, None, None), (None, text, "en", "s"), (2, None, "en", None)] + [
        (10 + i, text + f" y{i}", "en", "big") for i in range(300)] + [(999, text + " #######" * 60, "en", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("far", F.lit(0))
    got = sorted(((r.doc_id, r.kept) for r in Q.quality_rules(df).collect()), key=str)
    want = sorted([(1, True), (1, True), (None, True), (2, False), (999, False)] + [(10 + i, True) for i in range(300)], key=str)
    assert got == want
    assert Q.quality_rules(df.where("false")).collect() == []


def slow_mcd(groups, share=0.55, prior=50.0):
    """The same estimate by numpy with exact quantiles: squared distances over the cutoff, per group."""
    p = range(5)
    floor = np.array(Q.FLOORS)
    centre = {g: np.median(x, axis=0) for g, x in groups.items()}
    spread = {g: np.sqrt((1.4826 * np.median(abs(x - centre[g]), axis=0)) ** 2 + floor ** 2) for g, x in groups.items()}
    away = lambda x, m, s: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
    runs = []
    for start in Q.STARTS:
        params = {}
        for g, x in groups.items():
            z = (x - centre[g]) / spread[g]
            t = {"diagonal": None, "tanh": np.tanh(z), "sign": z / np.sqrt((z ** 2).sum(axis=1) + 1e-12)[:, None]}[start]
            r = np.eye(5)
            if t is not None:
                c = t.T @ t
                r = np.array([[1.0 if i == j else 0.99 * c[i, j] / np.sqrt(c[i, i] * c[j, j]) if c[i, i] * c[j, j] > 0 else 0.0 for j in p] for i in p])
            params[g] = centre[g], r * np.outer(spread[g], spread[g])
        for _ in range(8):
            core = {}
            for g, x in groups.items():
                d = away(x, *params[g])
                core[g] = x[d <= np.quantile(d, share)]
            every = np.concatenate(list(core.values()))
            pool = every.mean(axis=0), np.cov(every.T, bias=True)
            params = {}
            for g, x in core.items():
                w = prior / (len(x) + prior)
                m, c = x.mean(axis=0), np.cov(x.T, bias=True)
                params[g] = m - w * (m - pool[0]), (1 - w) * c + w * pool[1] + w * (1 - w) * np.outer(m - pool[0], m - pool[0]) + np.diag(floor ** 2)
        runs.append(params)
    best = {g: min((r[g] for r in runs), key=lambda v: np.linalg.det(v[1])) for g in groups}
    d = {g: away(x, *best[g]) for g, x in groups.items()}
    usual = np.log(np.median(np.concatenate(list(d.values()))))
    scale = {g: max(Q.CONSISTENCY, np.exp((len(x) * np.log(np.median(x)) + prior * usual) / (len(x) + prior)) / Q.CHI2_MEDIAN) for g, x in d.items()}
    return {g: x / scale[g] / Q.CHI2_CUTOFF for g, x in d.items()}


def test_outliers_match_numpy(spark):
    rng = np.random.default_rng(7)
    mixing = rng.normal(size=(5, 5))
    groups = {g: rng.normal(size=(n, 5)) @ mixing + g / 3 for g, n in ((0, 2000), (3, 700), (5, 12))}
    groups[0][:700] = rng.normal(size=(700, 5)) * 0.1 + 25  # 35 % of the rows lie together far away
    groups[5][:2] += 40
    rows = [(str(g), i, *map(float, x)) for g, xs in groups.items() for i, x in enumerate(xs)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "grp string, i int, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = {(r.grp, r.i): r.far for r in Q.outliers(df).collect()}
    want = slow_mcd(groups)
    for g, xs in groups.items():
        for i in range(len(xs)):
            if not 0.8 < want[g][i] < 1.25:
                assert got[str(g), i] == (want[g][i] > 1), (g, i, want[g][i])
    assert all(got["0", i] for i in range(700)) and got["5", 0] and got["5", 1]
    assert sum(got.values()) < 702 + 12


def sentence(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_each_statistic_alone_rejects_and_ordinary_texts_stay(spark):
    rng = random.Random(3)
    rows = []
    for lang, n in (("en", 400), ("de", 60), ("xx", 8)):
        for i in range(n):
            text = "\n".join(sentence(rng, rng.randint(8, 14)) for _ in range(rng.randint(8, 60)))
            rows.append((len(rows), text, lang, "web"))
    clean = len(rows)
    junk = {
        "lines": "\n".join(2 * [sentence(rng, 2) for _ in range(60)]),
        "repeats": sentence(rng, 110) + " " + "one two three four " * 25,
        "symbols": " ".join(w + " ###" for w in sentence(rng, 200).split()),
        "long words": " ".join("q" * 60 + str(i) for i in range(200)),
        "length": sentence(rng, 100_000),
    }
    for lang in ("en", "de", "xx"):
        rows += [(len(rows) + i, text, lang, "web") for i, text in enumerate(junk.values())]
    ordinary = len(rows)
    for i in range(400):  # a third of the group "yy" says every line twice
        lines = [sentence(rng, rng.randint(8, 14)) for _ in range(rng.randint(8, 60))]
        rows.append((ordinary + i, "\n".join(lines), "yy", "web"))
    rows += [(ordinary + 400 + i, "\n".join(2 * [sentence(rng, 2) for _ in range(40)]), "yy", "web") for i in range(200)]
    got = {r.doc_id: r.kept for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(not got[i] for i in [*range(clean), *range(ordinary, ordinary + 400)]) <= 3
    assert [(rows[i][2], list(junk)[(i - clean) % 5]) for i in range(clean, ordinary) if got[i]] == []
    assert not any(got[i] for i in range(ordinary + 400, ordinary + 600))
