"""Affinity edge sources (A3, A4): ``edges(src BIGINT, dst BIGINT, weight DOUBLE)``.

Weights must be nonnegative; a negative one fails the job with the actual
values in the message (quirk Q16 fixed).  The check is a column expression,
so it runs inside the scan's codegen stage, not as a separate pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checked(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight"
            ) -> DataFrame:
    w = F.col(weight).cast("double")
    msg = F.concat(F.lit("similarity must be nonnegative but found s("),
                   F.col(src).cast("string"), F.lit(", "), F.col(dst).cast("string"),
                   F.lit(") = "), w.cast("string"))
    return edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"),
                        F.when(w < 0, F.raise_error(msg)).otherwise(w).alias("weight"))


def graph(edges: DataFrame, symmetric: bool = False) -> tuple[DataFrame, bool]:
    """A4: a directed edge table flagged as already symmetric (F1's mirroring
    is skipped for it)."""
    return checked(edges), symmetric


PART_OFFSET = 1_000_000_000


def supplier_part_edges(lineitem: DataFrame) -> DataFrame:
    """Affinity between suppliers and parts: number of lineitems linking
    them.  One partial+final aggregate, linear in the data (no pair
    enumeration within an order).  Part ids are offset by 1e9."""
    return checked(lineitem.groupBy(
        F.col("l_suppkey").alias("src"),
        (F.col("l_partkey") + F.lit(PART_OFFSET)).alias("dst")).agg(
        F.count(F.lit(1)).cast("double").alias("weight")))
