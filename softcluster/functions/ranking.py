"""Positions of rows in a sorted order, without a one-task window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def number_rows(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """df with the row's position (LONG, from 0) in ``order``.

    Rows are range-partitioned; each partition counts on from the rows in
    those before it.  Only one count per partition reaches the driver.
    """
    # Written, so that counts and rows see the same partitions.
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted(dealt.groupBy("_part").count().collect())
    before = [0, *accumulate(r["count"] for r in sizes)]
    first = df.sparkSession.createDataFrame(
        [(r["_part"], n) for r, n in zip(sizes, before)], "_part int, _first long")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_rank", rank).join(F.broadcast(first), "_part").select(
        *df.columns, (F.col("_first") + F.col("_rank")).alias(out))
