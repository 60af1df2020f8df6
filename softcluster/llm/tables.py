"""Tables shared by the operators: inputs, written intermediates, bitmaps.

Intermediate tables that several jobs read are written as Parquet under the
shared folder of ``spark.checkpoint.dir``; a lost executor costs a re-read,
never a recomputation with other row ids.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from softcluster.session import ensure_checkpoint_dir, scratch_table_dir

__all__ = ["bitmap", "ensure_checkpoint_dir", "in_bitmap", "load", "written"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back."""
    path = f"{scratch_table_dir(df.sparkSession, name)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bitmap(df: DataFrame, column: str, log2_bits: int = 24) -> np.ndarray:
    """A bitmap of the low bits of a long column's values, as uint64 words.

    Its size is fixed (2**log2_bits bits), so it can be shipped to every task
    whatever the table's size.  It only ever lets too much through: callers
    join on the full value afterwards.
    """
    value = F.col(column).bitwiseAND(F.lit((1 << log2_bits) - 1))
    words = (df.where(F.col(column).isNotNull())
             .groupBy(F.shiftright(value, 6).alias("word"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits"))
             .toArrow())
    out = np.zeros(1 << (log2_bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which uint64 values may be in the bitmap."""
    low = values & np.uint64(len(bits) * 64 - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0
