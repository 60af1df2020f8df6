"""Model stores (A6-A11): parquet data tables plus a one-row ``meta`` table.

Every load checks the model name, format version, schema and size, and
restores the order by id.  Paths default to a fresh folder under the shared
checkpoint root; pass an explicit path for durable storage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_table_dir

VERSION = "1.0"
META_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("version", T.StringType(), False),
    T.StructField("k", T.IntegerType(), True),
    T.StructField("m", T.DoubleType(), True),
    T.StructField("epsilon", T.DoubleType(), True),
    T.StructField("vocab_size", T.IntegerType(), True),
    T.StructField("alpha", T.ArrayType(T.DoubleType()), True),
    T.StructField("eta", T.DoubleType(), True),
    T.StructField("gamma_shape", T.DoubleType(), True),
    T.StructField("rows_doc_topics", T.LongType()),
    T.StructField("rows_term_topics", T.LongType()),
])


def _path(spark: SparkSession, path: str | None, name: str) -> str:
    return path or scratch_table_dir(spark, f"{name}-{uuid.uuid4().hex}")


def _write_meta(spark, path, model, **fields):
    row = {f.name: None for f in META_SCHEMA.fields}
    row.update(model=model, version=VERSION, **fields)
    spark.createDataFrame([tuple(row[f.name] for f in META_SCHEMA.fields)],
                          META_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_meta(spark: SparkSession, path: str, model: str) -> dict:
    rows = spark.read.schema(META_SCHEMA).parquet(f"{path}/meta").collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: meta must hold one row")
    meta = rows[0].asDict()
    if meta["model"] != model:
        raise ValueError(f"{path}: expected a {model} model, found {meta['model']}")
    if meta["version"] != VERSION:
        raise ValueError(f"{path}: unsupported format version {meta['version']}")
    return meta


def _check_schema(df: DataFrame, schema: T.StructType, path: str) -> DataFrame:
    names = {f.name: f.dataType for f in df.schema.fields}
    for f in schema.fields:
        if names.get(f.name) != f.dataType:
            raise ValueError(f"{path}: column {f.name} must be {f.dataType.simpleString()}")
    return df.select(*[f.name for f in schema.fields])


def _write(df: DataFrame, path: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}")


# A6 / A7 ---------------------------------------------------------------------

CENTERS = T.StructType([T.StructField("cluster", T.IntegerType()),
                        T.StructField("center", T.ArrayType(T.DoubleType()))])


def save_centers(centers: DataFrame, path: str | None = None, model: str = "kmeans",
                 **meta) -> str:
    spark = centers.sparkSession
    path = _path(spark, path, model)
    k = centers.count()
    _write(centers.select("cluster", "center").coalesce(1), path, "data")
    _write_meta(spark, path, model, k=k, **meta)
    return path


def load_centers(spark: SparkSession, path: str, model: str = "kmeans"):
    """-> (centres DataFrame ordered by cluster, meta dict)."""
    meta = read_meta(spark, path, model)
    df = _check_schema(spark.read.parquet(f"{path}/data"), CENTERS, path)
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.min("cluster").alias("lo"),
                 F.max("cluster").alias("hi"), F.countDistinct("cluster").alias("nd")).first()
    if agg["n"] != meta["k"] or agg["nd"] != meta["k"] or agg["lo"] != 0 or agg["hi"] != meta["k"] - 1:
        raise ValueError(f"{path}: expected clusters 0..{meta['k'] - 1}")
    return df.orderBy("cluster"), meta


def save_fuzzy(centers: DataFrame, m: float, epsilon: float, path: str | None = None) -> str:
    """M is stored with the model (quirk Q3 fixed)."""
    return save_centers(centers, path, model="fuzzy-cmeans", m=float(m), epsilon=float(epsilon))


def load_fuzzy(spark: SparkSession, path: str):
    return load_centers(spark, path, model="fuzzy-cmeans")


# A8 ---------------------------------------------------------------------------

COMPONENTS = T.StructType([
    T.StructField("component", T.IntegerType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("mu", T.ArrayType(T.DoubleType())),
    T.StructField("sigma", T.ArrayType(T.ArrayType(T.DoubleType()))),
])


def save_mixture(components: DataFrame, path: str | None = None) -> str:
    spark = components.sparkSession
    path = _path(spark, path, "gmm")
    _write(components.coalesce(1), path, "data")
    _write_meta(spark, path, "gmm", k=components.count())
    return path


def load_mixture(spark: SparkSession, path: str) -> DataFrame:
    """Checks k rows and that every sigma is d x d with d = size(mu)."""
    meta = read_meta(spark, path, "gmm")
    df = _check_schema(spark.read.parquet(f"{path}/data"), COMPONENTS, path)
    bad = df.where((F.size("sigma") != F.size("mu")) |
                   F.exists("sigma", lambda r: F.size(r) != F.size(F.col("mu"))))
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.size("mu")).alias("nd")).first()
    if agg["n"] != meta["k"] or agg["nd"] != 1 or bad.limit(1).count():
        raise ValueError(f"{path}: mixture sizes do not match")
    return df.orderBy("component")


# A9 ---------------------------------------------------------------------------

ASSIGNMENTS = T.StructType([T.StructField("id", T.LongType()),
                            T.StructField("cluster", T.IntegerType())])


def save_assignments(assignments: DataFrame, k: int, path: str | None = None) -> str:
    spark = assignments.sparkSession
    path = _path(spark, path, "pic")
    _write(assignments.select("id", "cluster"), path, "data")
    _write_meta(spark, path, "pic", k=k)
    return path


def load_assignments(spark: SparkSession, path: str) -> DataFrame:
    read_meta(spark, path, "pic")
    return _check_schema(spark.read.parquet(f"{path}/data"), ASSIGNMENTS, path)


# A10 / A11 ------------------------------------------------------------------------

TOPICS = T.StructType([T.StructField("topic", T.IntegerType()),
                       T.StructField("term_id", T.IntegerType()),
                       T.StructField("weight", T.DoubleType())])


def save_topics(topics: DataFrame, k: int, vocab_size: int, alpha, eta: float,
                gamma_shape: float | None = None, path: str | None = None) -> str:
    spark = topics.sparkSession
    path = _path(spark, path, "lda")
    _write(topics.select("topic", "term_id", "weight"), path, "data")
    _write_meta(spark, path, "lda-local", k=k, vocab_size=vocab_size,
                alpha=[float(a) for a in alpha], eta=float(eta),
                gamma_shape=None if gamma_shape is None else float(gamma_shape))
    return path


def load_topics(spark: SparkSession, path: str):
    meta = read_meta(spark, path, "lda-local")
    df = _check_schema(spark.read.parquet(f"{path}/data"), TOPICS, path)
    return df, meta


def save_lda_state(token_counts: DataFrame, doc_topics: DataFrame, term_topics: DataFrame,
                   k: int, vocab_size: int, alpha, eta: float, path: str | None = None) -> str:
    """The three training-state tables (section 1) plus meta."""
    spark = token_counts.sparkSession
    path = _path(spark, path, "lda-state")
    _write(token_counts, path, "token_counts")
    _write(doc_topics, path, "doc_topics")
    _write(term_topics, path, "term_topics")
    _write_meta(spark, path, "lda-distributed", k=k, vocab_size=vocab_size,
                alpha=[float(a) for a in alpha], eta=float(eta),
                rows_doc_topics=doc_topics.count(), rows_term_topics=term_topics.count())
    return path


def load_lda_state(spark: SparkSession, path: str):
    meta = read_meta(spark, path, "lda-distributed")
    k = meta["k"]
    tabs = {n: spark.read.parquet(f"{path}/{n}")
            for n in ("token_counts", "doc_topics", "term_topics")}
    for n in ("doc_topics", "term_topics"):
        types = dict(tabs[n].dtypes)
        wrong = [f"n_{j}" for j in range(k) if types.get(f"n_{j}") != "double"]
        if wrong:
            raise ValueError(f"{path}/{n}: topic columns missing or not double: {wrong}")
        if tabs[n].count() != meta[f"rows_{n}"]:
            raise ValueError(f"{path}/{n}: rows differ from the saved table's")
    return tabs["token_counts"], tabs["doc_topics"], tabs["term_topics"], meta
