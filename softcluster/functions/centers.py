"""Centre tables: ``centers(cluster INT, center ARRAY<DOUBLE>)``, k rows.

Centres are model state of k x d numbers, the only thing a training loop
brings to the driver.  Conversions are size-checked so a mistaken call on a
data-sized table fails fast instead of dragging it through the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MAX_STATE_VALUES = 50_000_000  # k * d cap for driver-held state

CENTER_SCHEMA = T.StructType([
    T.StructField("cluster", T.IntegerType(), False),
    T.StructField("center", T.ArrayType(T.DoubleType(), False), False),
])


def to_df(spark: SparkSession, centers: np.ndarray, **extra) -> DataFrame:
    """numpy (k, d) -> centres DataFrame; extra per-cluster 1-d arrays too."""
    centers = np.asarray(centers, dtype=np.float64)
    fields = list(CENTER_SCHEMA.fields)
    for name, values in extra.items():
        v = np.asarray(values)
        typ = T.LongType() if v.dtype.kind in "iu" else T.DoubleType()
        fields.append(T.StructField(name, typ, True))
    rows = []
    for j, c in enumerate(centers):
        row = [j, [float(x) for x in c]]
        for name, values in extra.items():
            v = values[j]
            row.append(int(v) if isinstance(v, (int, np.integer)) else float(v))
        rows.append(row)
    return spark.createDataFrame(rows, T.StructType(fields))


def from_df(df: DataFrame, expected_k: int | None = None) -> np.ndarray:
    """Centres DataFrame -> numpy (k, d), ordered by cluster id."""
    k, values = df.agg(F.count(F.lit(1)), F.sum(F.size("center"))).first()
    if expected_k is not None and k != expected_k:
        raise ValueError(f"expected {expected_k} centres, got {k}")
    if (values or 0) > MAX_STATE_VALUES:
        raise ValueError("centre table too large to hold as model state")
    rows = df.select("cluster", "center").orderBy("cluster").collect()
    ids = [r["cluster"] for r in rows]
    if ids != list(range(len(rows))):
        raise ValueError(f"cluster ids must be 0..k-1, got {ids[:10]}...")
    return np.array([r["center"] for r in rows], dtype=np.float64)


def group_means(points: DataFrame, group: "F.Column", features: str = "features",
                dim: int | None = None) -> DataFrame:
    """Start centres: per-group feature means, group ids re-numbered 0..g-1."""
    g = points.withColumn("_g", group)
    if dim is None:
        dim = len(g.select(features).first()[0])
    means = g.groupBy("_g").agg(
        *[F.avg(F.col(features)[i]).alias(f"_m{i}") for i in range(dim)])
    # k rows after the aggregate: a global order over them is cheap.
    w = Window.orderBy("_g")
    return means.select(
        (F.row_number().over(w) - 1).cast("int").alias("cluster"),
        F.array(*[F.col(f"_m{i}") for i in range(dim)]).alias("center"))


def long_form(centers: DataFrame, digits: int = 6) -> DataFrame:
    """(cluster, center[]) -> (cluster, dim, value) rounded: oracle-friendly."""
    return centers.select(
        "cluster", F.posexplode("center").alias("dim", "value")).select(
        F.col("cluster").cast("int").alias("cluster"),
        F.col("dim").cast("int").alias("dim"),
        F.round("value", digits).alias("value"))
