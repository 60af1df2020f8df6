"""Connected components of a link table, by alternating stars.

Each round hangs every node's larger neighbours on its smallest one, then
every node's smaller neighbours (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014).  A round is aggregations and joins on the node;
the links are written to the shared folder each round, so plans stay small
and nothing is gathered on the driver but two numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softcluster.llm.tables import written


def _hang(links: DataFrame) -> DataFrame:
    """One round on links u > v."""
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .distinct())
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = (large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return small.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots' own rows are included.

    ``links`` has two long columns a, b; repeats, loops and either direction
    are allowed, rows with a null are left out.  root is the least node of the
    component.  No links: no rows.
    """
    a, b = links.columns[:2]
    now = written(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct(),
        "links")
    seen = None
    while True:
        # Stars alone remain once a round changes nothing.
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        now = written(_hang(now), "links")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        roots.select("node", F.col("node").alias("root")))
