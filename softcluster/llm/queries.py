"""The registered queries of the operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softcluster.llm import chat, decontaminate, licenses, lines, negatives, packing, quality_classifier, quality_rules, resampling, secrets, simhash, sql, substring_dedup, warc
from softcluster.llm.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_decontaminate(spark, sf_dir):
    """Hit words and items of every document."""
    out = decontaminate.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op4_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


ORACLES["op3_decontaminate"] = sql.DECONTAMINATE


@query
def op7_pack(spark, sf_dir):
    """Pieces of every document in windows of 2,048 ids."""
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")).drop("ids", "queue")


@query
def op8_secrets(spark, sf_dir):
    """Secrets in every document."""
    found = secrets.scan(load(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.KINDS))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[count(i).alias(f"n_{k.name}") for i, k in enumerate(secrets.KINDS)],
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


@query
def op10_quality_rules(spark, sf_dir):
    """Counts and verdict of every document."""
    return quality_rules.quality_rules(load(spark, sf_dir, "documents"))


@query
def op2_quality_classifier(spark, sf_dir):
    """Scores and verdict of every document."""
    return quality_classifier.quality_classifier(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op5_chat_format(spark, sf_dir):
    """Every conversation formatted and read back, and one of control strings as texts."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], rows.schema)
    path = tokenizer("byte_bpe_50k.json")
    return chat.read_back(chat.assemble(rows.unionAll(own), path), path)


ORACLES["op5_chat_format"] = sql.CHAT


@query
def op6_warc(spark, sf_dir):
    """The records of every page, without their blocks' texts."""
    return warc.derive(load(spark, sf_dir, "pages")).drop("block").withColumn("headers_sha256", F.sha2("headers", 256)).drop("headers")


@query
def op9_licenses(spark, sf_dir):
    """License notices in every document."""
    return licenses.scan(load(spark, sf_dir, "documents"))


@query
def op1_substring_dedup(spark, sf_dir):
    """Documents with passages of 50 words or more that other documents have."""
    return substring_dedup.passages(load(spark, sf_dir, "documents"))


ORACLES["op8_secrets"] = sql.secrets_sql(secrets.KINDS, secrets.CANDIDATE, secrets.CLASSES, secrets.ALLOWED, secrets.PLAIN, secrets.SEPARATOR)
ORACLES["op9_licenses"] = sql.licenses_sql(licenses.TEMPLATES)


@query
def op12_line_dedup(spark, sf_dir):
    """Every document without the lines that ten documents or more hold."""
    return lines.line_dedup(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op12_line_dedup"] = sql.LINE_DEDUP


@query
def op13_resample(spark, sf_dir):
    """Weight, noisy score and rank of every document against the benchmark's words."""
    return resampling.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


ORACLES["op13_resample"] = sql.RESAMPLE


@query
def op11_hard_negatives(spark, sf_dir):
    """The hard negatives of every hundredth row for each of its positives."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    points = negatives.integer_rows(load(spark, sf_dir, "embeddings"), moved, F.col("embedding"))
    return negatives.hard_negatives(points, F.col("id") % 100 == 0)


ORACLES["op11_hard_negatives"] = sql.HARD_NEGATIVES
