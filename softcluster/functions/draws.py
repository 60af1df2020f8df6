"""Random draws keyed by rows: the same on any cluster and in any order.

A draw is a hash of a seed and of the row's key, never a generator that runs
along a partition.  So a retried task, another number of partitions or another
engine draws the same.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BITS = 52


def uniform(seed: int, *key: Column | str) -> Column:
    """A draw in (0, 1): the first 52 bits of the MD5 of ``seed:key:..``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long") + 0.5) / float(1 << BITS)


def uniform_value(seed: int, *key) -> float:
    """The same draw on the driver."""
    text = ":".join(map(str, (seed, *key)))
    return (int(hashlib.md5(text.encode()).hexdigest()[:BITS // 4], 16) + 0.5) / float(1 << BITS)


def uniform_sql(seed: int, *key: str) -> str:
    """The same draw in DuckDB, for keys given as SQL expressions."""
    text = f"concat_ws(':', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in key)})"
    return f"((('0x' || substr(md5({text}), 1, {BITS // 4}))::BIGINT + 0.5::DOUBLE) / {1 << BITS}::DOUBLE)"


def normal(seed: int, *key: Column | str) -> Column:
    """A standard normal draw (Box-Muller on two uniform ones)."""
    return F.sqrt(-2 * F.log(uniform(seed, *key, F.lit("r")))) * F.cos(2 * math.pi * uniform(seed, *key, F.lit("a")))


def normal_value(seed: int, *key) -> float:
    return math.sqrt(-2 * math.log(uniform_value(seed, *key, "r"))) * math.cos(2 * math.pi * uniform_value(seed, *key, "a"))


def normal_sql(seed: int, *key: str) -> str:
    r, a = (uniform_sql(seed, *key, f"'{s}'") for s in "ra")
    return f"(sqrt(-2 * ln({r})) * cos({2 * math.pi!r}::DOUBLE * {a}))"


def poisson_steps(mean: float) -> list[float]:
    """The cumulative probabilities of 0, 1, 2, .. copies, while a draw can be beyond them."""
    out, p, total = [], math.exp(-mean), 0.0
    while total + p < 1.0 - 2.0 ** -53 and len(out) < 10_000:
        total += p
        out.append(total)
        p *= mean / len(out)
    return out


def poisson(mean: float, draw: Column) -> Column:
    """The number of copies that a uniform draw stands for."""
    steps = poisson_steps(mean)
    return F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s <= draw)) if steps else F.lit(0)


def row_key(*columns: str) -> Column:
    """A key of a row by its values, for tables without one of their own."""
    return F.xxhash64(*columns)


def first_distinct(df: DataFrame, columns: list[str], n: int, seed: int, key: Column | None = None) -> list:
    """The n distinct rows (all, if fewer) of the least draws, in their order.

    Equal rows have equal draws.  Only rows under a threshold are aggregated,
    which grows from a few times n of all rows until n distinct ones are found.
    """
    draw = uniform(seed, row_key(*columns) if key is None else key)
    rows = df.select(*columns, draw.alias("_draw"))
    total = df.count()
    share = 4 * n / max(1, total)
    while True:
        under = rows.where(F.col("_draw") < share) if share < 1 else rows
        found = under.groupBy(*columns, "_draw").agg(F.lit(1)).orderBy("_draw", *columns).limit(n).select(*columns).collect()
        if len(found) == n or share >= 1:
            return found
        share *= 16


def sample_rows(df: DataFrame, columns: list[str], n: int, seed: int, key: Column | None = None) -> DataFrame:
    """n rows (all, if fewer) without replacement, with column ``place`` (0 ..).

    With a ``key`` that tells rows apart these are the rows of the least draws.
    Without one, equal rows are counted and each distinct row draws as many
    order statistics of its copies as could be among the first n.
    """
    if key is not None:
        drawn = df.select(*columns, uniform(seed, key).alias("_draw"))
    else:
        counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_key", row_key(*columns))

        def following(drawn, j):
            last = F.coalesce(F.get(drawn, j - 2), F.lit(0.0))
            least = -F.expm1(F.log1p(-uniform(seed, F.col("_key"), j)) / (F.col("_n") - j + 1))
            return F.concat(drawn, F.array(last + (1 - last) * least))

        copies = F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(n)).cast("int"))
        drawn = counted.withColumn("_draw", F.explode(F.aggregate(copies, F.array().cast("array<double>"), following)))
    first = drawn.orderBy("_draw", *columns).limit(n)  # per-partition first n, then n rows
    place = F.row_number().over(Window.orderBy("_draw", *columns)) - 1
    return first.select(*columns, place.alias("place"))
