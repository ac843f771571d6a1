"""Statistics of query times."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.runtime import write


def values_at(values: DataFrame, column: str, positions: list[float]) -> list[float]:
    """The values at these positions (from 1, between two values in proportion)
    of a column without nulls, in order; exact.

    Equal values are counted together, the distinct ones are split by range, and
    only the ranges that hold a position are looked into: no task sees all.
    """
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranges = write(counts.repartitionByRange("v").withColumn("p", F.spark_partition_id()), "value-ranges")
    sizes = [(r["p"], r["n"]) for r in ranges.df.groupBy("p").agg(F.sum("n").alias("n"), F.min("v").alias("v")).orderBy("v").collect()]
    wanted = sorted({r for p in positions for r in (math.floor(p), math.ceil(p))})
    found: dict[int, float] = {}
    before = 0
    for p, n in sizes:
        here = [r for r in wanted if before < r <= before + n]
        if here:
            upto = F.sum("n").over(Window.orderBy("v")) + before
            rows = ranges.df.where(F.col("p") == p).withColumn("upto", upto)
            for r in rows.where(" or ".join(f"(upto >= {r} and upto - n < {r})" for r in here)).collect():
                found |= {k: r["v"] for k in here if r["upto"] - r["n"] < k <= r["upto"]}
        before += n
    ranges.drop()
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in positions]


def query_times(df: DataFrame, seconds: str, failed: str | None = None) -> DataFrame:
    """One row: queries, mean, median, min, max, p95 (exclusive), total,
    queries per second and errors.

    The exclusive 95th percentile lies at position 0.95 * (n + 1), clamped to
    the ends.  Nulls are left out, and so are rows whose column ``failed`` is
    true, which count as errors; without any row the figures are null.
    """
    error = F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(False)
    base = df.where(F.col(seconds).isNotNull() & ~error).select(F.col(seconds).cast("double").alias("v"))
    errors = df.where(error).count() if failed else 0
    n = base.count()
    median = p95 = None
    if n:
        median, p95 = values_at(base, "v", [(n + 1) / 2, min(float(n), max(1.0, 0.95 * (n + 1)))])
    return base.agg(
        F.count(F.lit(1)).alias("queries"), F.avg("v").alias("mean"), F.lit(median).cast("double").alias("median"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.lit(p95).cast("double").alias("p95"), F.sum("v").alias("total"),
    ).withColumns({
        "per_second": F.when(F.col("total") > 0, F.col("queries") / F.col("total")), "errors": F.lit(errors).cast("long"),
    })
