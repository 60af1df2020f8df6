"""Stream source of points (A5) and a replayable feed of blocks for queries/tests.

``points_stream`` reads a folder of parquet files, a given number per
micro-batch (``maxFilesPerTrigger``), oldest first.  ``write_feed`` makes a
feed of a table: one pass deals its rows to a folder per block, and a manifest
gets one small file per block, in block order, that names the folder.  The
stream is the manifest, one entry per micro-batch, and a batch reads the files
its entry names.  So a block may have any number of files of any size: each
task of a batch reads about ``spark.sql.files.maxPartitionBytes``, whatever the
other blocks are like, and a replayed batch reads the same files again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import scratch_table_dir

#: Spark's folder name of a null partition value.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
MANIFEST = T.StructType([T.StructField("path", T.StringType(), False)])


def points_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1
                  ) -> DataFrame:
    return (spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", files_per_trigger)
            .option("latestFirst", "false")
            .parquet(path))


@dataclass(frozen=True)
class BlockFeed:
    """A manifest of block folders and the schema of their rows."""

    manifest: str
    schema: T.StructType

    def stream(self, spark: SparkSession) -> DataFrame:
        """The stream of manifest entries, one block per micro-batch."""
        return points_stream(spark, f"{self.manifest}/*", MANIFEST)

    def rows(self, entries: DataFrame) -> DataFrame:
        """The rows of a micro-batch of entries (a block or a few)."""
        paths = [r["path"] for r in entries.collect()]
        spark = entries.sparkSession
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)


def write_feed(df: DataFrame, block_col: str, name: str = "feed") -> BlockFeed:
    """A feed with one block per value of ``block_col``, in its order.  Only
    block values reach the driver."""
    spark = df.sparkSession
    root = scratch_table_dir(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.partitionBy(block_col).parquet(f"{root}-blocks")
    blocks = spark.read.parquet(f"{root}-blocks").select(block_col).distinct().orderBy(block_col).collect()
    for i, r in enumerate(blocks):
        value = NULL_FOLDER if r[0] is None else r[0]
        entry = spark.createDataFrame([(f"{root}-blocks/{block_col}={value}",)], MANIFEST)
        entry.coalesce(1).write.parquet(f"{root}/b{i:08d}")
    return BlockFeed(root, df.drop(block_col).schema)
