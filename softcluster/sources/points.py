"""Points source (A1): a table of equal-length ``ARRAY<DOUBLE>`` feature rows.

Every operator consumes ``points(features ARRAY<DOUBLE>[, id][, weight])``.
Rows whose feature array is null or holds a null element are dropped; the
dimension is checked with ONE aggregate (min(size) = max(size)) instead of
reading the first row on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

FEATURES = "features"


def assemble(df: DataFrame, columns: list, *, keep: list[str] | tuple = (),
             out: str = FEATURES, drop_nulls: bool = True) -> DataFrame:
    """Numeric columns (names or Column expressions) -> one ARRAY<DOUBLE>.

    Rows with a null input are dropped by a filter on the source columns,
    which Catalyst pushes into the scan (IsNotNull) and keeps in codegen; the
    array then never holds a null element, so ``clean`` is not needed."""
    exprs = [F.col(c) if isinstance(c, str) else c for c in columns]
    if drop_nulls:
        cond = None
        for e in exprs:
            cond = e.isNotNull() if cond is None else cond & e.isNotNull()
        df = df.where(cond)
    return df.select(*keep, F.array(*[e.cast("double") for e in exprs]).alias(out))


def from_array(df: DataFrame, column: str, *, keep: list[str] | tuple = (),
               out: str = FEATURES) -> DataFrame:
    """An existing numeric array column (float, int, ...) -> ARRAY<DOUBLE>."""
    return df.select(*keep, F.col(column).cast("array<double>").alias(out))


def clean(points: DataFrame, col: str = FEATURES) -> DataFrame:
    """Drop rows with a null array or a null element (nulls are never imputed)."""
    c = F.col(col)
    return points.where(c.isNotNull() & ~F.exists(c, lambda x: x.isNull()))


@dataclass
class PointStats:
    rows: int
    dropped: int
    dim: int


def validate(points: DataFrame, col: str = FEATURES) -> PointStats:
    """One pass: row count, null-row count, dimension; unequal lengths raise."""
    c = F.col(col)
    flagged = points.select((c.isNull() | F.exists(c, lambda x: x.isNull())).alias("_bad"),
                            F.size(c).alias("_size"))
    r = flagged.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_bad").cast("int")).alias("bad"),
        F.min(F.when(~F.col("_bad"), F.col("_size"))).alias("lo"),
        F.max(F.when(~F.col("_bad"), F.col("_size"))).alias("hi"),
    ).first()
    n, nbad = int(r["n"]), int(r["bad"] or 0)
    if n - nbad == 0:
        raise ValueError("points table holds no usable row")
    if r["lo"] != r["hi"]:
        raise ValueError(f"feature arrays differ in length: {r['lo']} .. {r['hi']}")
    if r["lo"] == 0:
        raise ValueError("feature arrays are empty")
    return PointStats(rows=n - nbad, dropped=nbad, dim=int(r["lo"]))


def norm_expr(col: str = FEATURES) -> Column:
    """L2 norm of an array column, computed JVM-side."""
    return F.sqrt(F.aggregate(F.col(col), F.lit(0.0), lambda acc, x: acc + x * x))


def with_norms(points: DataFrame, col: str = FEATURES, out: str = "norm") -> DataFrame:
    return points.withColumn(out, norm_expr(col))


def prepare(points: DataFrame, col: str = FEATURES, *, persist: bool = True):
    """Clean + persist + validate for iterative use.  Returns (df, stats).

    The checks read the persisted copy, so the source is scanned once.  It is
    MEMORY_AND_DISK: a lost executor recomputes its blocks from the parquet
    scan, so no state is lost with it.
    """
    df = spread(clean(points, col))
    if persist:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df, validate(df, col)
