"""Fixture tables built by Spark from the driver's parquet tables.

Each fixture is a plain projection of a whole table (no row subsets), so the
work of every registered query grows with the data.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import points as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def points_li(spark, sf_dir) -> DataFrame:
    """lineitem -> features [quantity, price/1000, discount, tax].

    (l_orderkey, l_linenumber) is carried along but is NOT a key.
    """
    li = table(spark, sf_dir, "lineitem")
    return P.assemble(
        li, ["l_quantity", F.col("l_extendedprice") / 1000.0, "l_discount", "l_tax"],
        keep=["l_orderkey", "l_linenumber"])


def points_li2(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return P.assemble(li, ["l_quantity", F.col("l_extendedprice") / 1000.0],
                      keep=["l_orderkey", "l_linenumber"])


def points_ev(spark, sf_dir) -> DataFrame:
    """events -> (event_id, features [value/100, hour(ts)/24])."""
    ev = table(spark, sf_dir, "events")
    return P.assemble(ev, [F.col("value") / 100.0, F.hour("ts") / 24.0], keep=["event_id"])


def points_emb(spark, sf_dir) -> DataFrame:
    """embeddings -> (vec_id, label, features ARRAY<DOUBLE>(64))."""
    em = table(spark, sf_dir, "embeddings")
    return P.clean(P.from_array(em, "embedding", keep=["vec_id", "label"]))


def quantity_groups(points: DataFrame) -> "F.Column":
    """Start-centre grouping for lineitem: floor(quantity / 13), 4 groups."""
    return F.floor(F.col(P.FEATURES)[0] / 13.0)
