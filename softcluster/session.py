"""Session helpers: a local session for tests/bench and lineage cutting.

Lineage is cut with reliable ``checkpoint()`` into the shared folder the
cluster names in ``spark.checkpoint.dir``.  A folder is only chosen here when
the session has none (local tests); on a cluster the setting must point at
shared storage so a lost executor never loses a checkpoint.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "softcluster") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ensure_importable(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting a local one only when unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError(
                "set spark.checkpoint.dir to a shared folder (HDFS/S3/NFS): lineage is "
                "cut with reliable checkpoints and state tables are written there")
        # Local runs and tests only: nothing configured, one machine.
        conf_dir = tempfile.mkdtemp(prefix="softcluster-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back.

    The table read has the files' own statistics.  A ``checkpoint()`` would
    keep the estimates of the plan it cut, which multiply at every join: in a
    loop over joins their digits double each step.
    """
    path = scratch_table_dir(df.sparkSession, f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_table_dir(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint root for written state tables."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/tables/{name}"


NARROW = 8


def spread(df: DataFrame) -> DataFrame:
    """Give a narrow input ``NARROW`` partitions.

    A small source (one parquet row group) arrives as one partition and would
    run every pass in one task.  Only then is it repartitioned, to the same
    number on any cluster; a larger input is returned untouched, so no
    shuffle is ever added at scale.
    """
    from pyspark.sql import functions as F

    if df.rdd.getNumPartitions() >= NARROW:
        return df
    # Hash on a per-row id: even, deterministic on recompute, and no
    # per-partition sort (which a round-robin repartition needs).
    return df.repartition(NARROW, F.monotonically_increasing_id())


PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package.

    Arrow kernels and pandas UDFs are pickled by reference to their module,
    so every worker must find ``softcluster``.  Spark adds the PYTHONPATH of
    ``sc.environment`` to each worker it starts; this sets it once per
    context.  (On a cluster the package is deployed with the job, e.g.
    ``--py-files`` or an installed wheel, and this is a no-op there.)
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT] + paths)
