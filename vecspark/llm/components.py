"""Connected components of a table of links by alternating stars.

Every round writes its links to the shared folder, which cuts lineage and
outlives lost executors; the driver sees only two counts a round.  Hot nodes
are handled by aggregation with map-side combine and by AQE's skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.runtime import write


def _both(e: DataFrame) -> DataFrame:
    return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger, or itself and the smaller ones) are
    linked to the smallest among the node and its neighbours."""
    if large:
        near = _both(e)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = near.where("b > a").join(least, "a").select(F.col("b"), F.col("m"))
    else:
        near = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        out = near.join(least, "a").select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m"))
    return out.where("b <> m").select(F.col("m").alias("a"), F.col("b")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node in ``links``; the component is named by
    its smallest node.  Loops and repeated links do no harm; without links the
    result is empty."""
    e = write(
        links.where(F.col(a) != F.col(b))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct(),
        "links",
    )
    mark = None
    while True:
        step = write(_star(_star(e.df, True), False), "links")
        n, check = step.df.agg(
            F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
        ).first()
        e.drop()
        e = step
        if (n, check) == mark:
            break
        mark = (n, check)
    stars = e.df
    return stars.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        stars.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
