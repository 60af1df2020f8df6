"""JVM-side column expressions on arrays of one value per cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_argmax(arr: Column) -> Column:
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def explode_clusters(df: DataFrame, keep: list, k: int, arr: str = "u",
                     out: str | None = None, extra: list | tuple = ()) -> DataFrame:
    """Long form of a per-row k-array: (keep.., extra.., cluster INT, value)."""
    out = out or arr
    g = df.select(*keep, *extra, arr,
                  F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cluster"))
    return g.select(*keep, *extra, F.col("cluster").cast("int").alias("cluster"),
                    F.col(arr)[F.col("cluster")].alias(out))
