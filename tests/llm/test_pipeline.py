"""The pipeline's stages against brute force over each one's own input."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from test_decontaminate import words
from test_packing import check as check_packed
from test_secrets import spans
from test_simhash import slow_components, slow_fingerprint
from tokenizers import Tokenizer
import public_tokenizers

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "packing"]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality_keeps_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    kept = {r.doc_id for r in stages[1].collect()}
    clean = [r.doc_id for r in labels if r.quality == 1 and not r.toxic]
    assert sum(d in kept for d in clean) > 0.95 * len(clean)
    poor = [r.doc_id for r in labels if r.quality == 0]
    assert sum(d in kept for d in poor) < 0.1 * len(poor)


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(slow_components(rows)))


def test_contaminated_documents_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    grams = defaultdict(list)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9)):
            grams[tuple(w[s:s + 10])].append(i)

    def dirty(text):
        w = words(text)
        return any(tuple(w[s:s + n]) in grams for n in {len(g) for g in grams} for s in range(len(w) - n + 1))
    want = sorted(r.doc_id for r in stages[2].collect() if not dirty(r.text))
    assert sorted(r.doc_id for r in stages[3].collect()) == want


def test_secrets_are_masked(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    after = {r.doc_id: r for r in stages[4].collect()}
    assert before.keys() == after.keys()
    for d, r in before.items():
        text, end = "", 0
        for a, _, b in spans(r.text):
            if a >= end:
                text += r.text[end:a] + "[secret]"
            end = max(end, b)
        assert after[d].text == text + r.text[end:] and after[d].n_chars == len(after[d].text)
        assert not re.search("AKIA[A-Z0-9]{16}", after[d].text)


def test_packing(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    check_packed(tokenizer, {r.doc_id: r.text for r in stages[4].collect()}, stages[5].collect(), 2048)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_odd_rows_and_clashing_columns(spark):
    long = " ".join(f"The of and w{i}" for i in range(20000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a token=abcdefgh1 b", "en", None, 19), (3, "a token=abcdefgh1 b", "en", None, 19),
            (None, "no id", None, "s", 5), (None, "no id", None, "s", 5), (4, long, "en", "s", len(long)), (5, long.upper(), "en", "s", len(long))]
    names = "row k0 c0 fp ids queue x0 kept score found spans key n start words".split()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", *[f"'{n}' as {n}" for n in names]).repartition(3)
    functions = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert all(r[n] == n for r in kept for n in names)
        if name == "simhash_near_dedup":  # null and empty texts are one group, as are the long ones
            assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "4", "None"]
        elif name == "secret_scan":
            assert len(kept) == len(rows) and {r.text for r in kept if r.doc_id == 3} == {"a [secret] b"}
        elif name == "benchmark_decontamination":
            assert len(kept) == len(rows)
    pieces = functions["packing"](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {None, 1, 2, 3, 4, 5}


def test_texts_are_sent_once(spark, monkeypatch):
    """A text that a stage reads and keeps goes to Python in one column."""
    from softcluster.llm import decontaminate, quality_classifier, simhash

    docs = spark.createDataFrame([(i, "en", "web", f"some words of text {i}", 20) for i in range(80)],
                                 "doc_id long, lang string, source string, text string, n_chars int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(0, "some words of text 7")], "item_id long, text string")
    sent = []

    def noted(df, name):
        plan = df._jdf.queryExecution().analyzed().toString()
        sent.extend(line for above, line in zip(plan.split("\n"), plan.split("\n")[1:]) if "MapInArrow run" in above or "MapInArrow match" in above
                    or "MapInArrow score" in above)
        return corpus_pipeline.written(df, name)

    monkeypatch.setattr(simhash, "written", noted)
    monkeypatch.setattr(decontaminate, "written", noted)
    noted(quality_classifier.keep_good(docs, labels), "quality")
    assert simhash.keep_one(docs).count() > 0
    assert decontaminate.keep_clean(docs, items).count() == 79
    # SimHash names the columns c0, c1, .. before; the text is c3.
    sent = [line.count("text#") + line.count("c3#") for line in sent if "source#" in line or "c2#" in line]
    assert sent == [1, 1, 1]
