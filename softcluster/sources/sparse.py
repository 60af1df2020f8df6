"""Sparse points (A1): rows of non-zeros in place of dense feature arrays.

A table ``(id, indices ARRAY<INT>, values ARRAY<DOUBLE>)``, indices rising and
values aligned with them.  Everything beyond the listed indices is zero, so the
dimension is no property of a row and may be in the millions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDICES, VALUES = "indices", "values"


def from_entries(entries: DataFrame, row: str, index: str, value: str) -> DataFrame:
    """(row, index, value) entries -> (id, indices, values).

    Entries of one place are added up; zeros and entries with a null place or
    value are left out.  A row's non-zeros come together in one cell.
    """
    cells = (entries.where(F.col(row).isNotNull() & F.col(index).isNotNull() & F.col(value).isNotNull())
             .groupBy(F.col(row).alias("id"), F.col(index).cast("int").alias("i"))
             .agg(F.sum(F.col(value).cast("double")).alias("v")).where("v <> 0"))
    rows = cells.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("cells"))
    return rows.select("id", F.col("cells.i").alias(INDICES), F.col("cells.v").alias(VALUES))


def from_bags(bags: DataFrame) -> DataFrame:
    """Bags (doc_id, terms rising, counts) -> (id, indices, values); a null id is left out."""
    return bags.where("doc_id is not null").select(F.col("doc_id").alias("id"), F.col("terms").alias(INDICES), F.col("counts").alias(VALUES))


def from_dense(points: DataFrame, features: str, id_column: str = "id") -> DataFrame:
    """Dense arrays -> (id, indices, values) of their non-zeros; rows with a null are dropped."""
    cells = F.filter(F.transform(features, lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("v"))), lambda c: c["v"] != 0)
    ok = F.col(features).isNotNull() & ~F.exists(features, lambda x: x.isNull())
    return points.where(ok).select(F.col(id_column).alias("id"), cells.alias("cells")).select(
        "id", F.col("cells.i").alias(INDICES), F.col("cells.v").alias(VALUES))


def norm_expr() -> Column:
    return F.sqrt(F.aggregate(VALUES, F.lit(0.0), lambda acc, x: acc + x * x))


def unit_length(points: DataFrame) -> DataFrame:
    """Rows divided by their norm; a row without non-zeros stays as it is."""
    # The norm is an array of its own: named in a lambda it would be computed anew for every value.
    norms = F.array_repeat(norm_expr(), F.size(VALUES))
    return points.withColumn(VALUES, F.zip_with(VALUES, norms, lambda x, n: x / n))


@dataclass
class SparseStats:
    rows: int
    nonzeros: int
    dim: int


def validate(points: DataFrame) -> SparseStats:
    """One pass: rows, non-zeros, dimension.  Raises on nulls, unequal lengths,
    negative or unordered indices."""
    i, v = F.col(INDICES), F.col(VALUES)
    # array_sort and array_distinct change nothing about strictly rising indices.
    bad = (i.isNull() | v.isNull() | (F.size(i) != F.size(v)) | F.exists(v, lambda x: x.isNull())
           | F.exists(i, lambda x: x.isNull() | (x < 0)) | (i != F.array_sort(F.array_distinct(i))))
    r = points.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(bad, F.lit(True)).cast("int")).alias("bad"),
                   F.sum(F.size(i).cast("long")).alias("nonzeros"), F.max(F.array_max(i)).alias("top")).first()
    if r["bad"]:
        raise ValueError(f"{r['bad']} sparse rows with nulls, unequal lengths or unordered indices")
    return SparseStats(r["n"], r["nonzeros"] or 0, 0 if r["top"] is None else r["top"] + 1)
