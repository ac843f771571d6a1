"""References to records that do not exist.

Parent and child keys are brought into one long form, tagged, and grouped by
key.  The grouping is a sum of flags, so a hot key is combined on the map side
and costs one row per task.  Only groups that lack the parent (or whose parent
is younger than a child) go back to their child rows.

Defined cases: null references are no cases; a reference of blanks is compared
as the empty key and so is normally missing; repeated child rows give one
result row; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.runtime import join_groups, write


def normal_key(c: Column) -> Column:
    """Keys are compared without spaces around them and in lower case."""
    return F.lower(F.trim(c))


def point_millis(point_id: Column) -> Column:
    """Unix milliseconds in the first 12 hex digits of a time-ordered id."""
    digits = F.substring(F.regexp_replace(F.regexp_replace(point_id, "^[^-]*-", ""), "-", ""), 1, 12)
    return F.conv(digits, 16, 10).cast("long")


def _references(df: DataFrame, table: str, row_key: str, millis: Column, *fields: str) -> DataFrame:
    """One row per reference: all of a row's come from one reading of it."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("ref_field"), normal_key(F.col(f)).alias("key")) for f in fields)))
    return (
        df.select(F.lit(table).alias("ref_table"), F.col(row_key).alias("row_key"), millis.cast("double").alias("ms"), each.alias("r"))
        .where("r.key is not null").select("ref_table", "r.ref_field", "row_key", "r.key", "ms")
    )


def _parents(df: DataFrame, flag: str, **created: Column) -> DataFrame:
    """Keys of the given fields, with the time from which they exist."""
    each = F.explode(F.array(*(
        F.struct(F.lit(f).alias("ref_field"), normal_key(F.col(f)).alias("key"), at.cast("long").alias("created_ms"))
        for f, at in created.items()
    )))
    return df.select(each.alias("r"), F.lit(flag).alias("tag")).where("r.key is not null").select("r.ref_field", "r.key", "tag", "r.created_ms")


def orphan_references(
    points: DataFrame,
    results: DataFrame,
    store: DataFrame,
    removed: DataFrame,
    incoming: DataFrame,
) -> DataFrame:
    """One row per reference without a (timely) counterpart in ``store``:
    (ref_table, ref_field, row_key, ref_status, year_month)."""
    searched = F.unix_micros(F.col("searched_at").cast("timestamp")) / 1000
    children = _references(
        points, "points", "point_id", point_millis(F.col("point_id")), "document_id", "content_md5"
    ).unionByName(_references(results, "search_results", "result_id", searched, "document_id"))
    never = F.lit(None)
    parents = (
        _parents(store, "store", document_id=F.col("created_at").cast("long") * 1000, content_md5=never)
        .unionByName(_parents(removed, "removed", document_id=never))
        .unionByName(_parents(incoming, "incoming", document_id=never))
    )
    long = children.select(
        "ref_field", "key", F.lit("child").alias("tag"), F.lit(None).cast("long").alias("created_ms"), "ms"
    ).unionByName(parents.withColumn("ms", F.lit(None).cast("double")))

    def has(tag: str) -> Column:
        return F.max(F.col("tag") == tag)

    groups = (
        long.groupBy("ref_field", "key")
        .agg(
            has("store").alias("in_store"),
            has("removed").alias("in_removed"),
            has("incoming").alias("in_incoming"),
            F.min("created_ms").alias("created_ms"),
            F.min("ms").alias("first_ms"),
            F.sum((F.col("tag") == "child").cast("long")).alias("n_children"),
        )
        .where("n_children > 0 and (not in_store or created_ms > first_ms)")
        .withColumn("group_key", F.concat_ws(":", "ref_field", "key"))
        .drop("ref_field", "key")
    )
    kept = write(groups, "orphan-groups").df
    total = kept.agg(F.coalesce(F.sum("n_children"), F.lit(0))).first()[0]
    rows = children.withColumn("group_key", F.concat_ws(":", "ref_field", "key"))
    status = (
        F.when(F.col("in_store"), F.lit("late"))
        .when(F.col("ref_field") == "content_md5", F.lit("missing"))
        .when(F.col("in_removed"), F.lit("removed"))
        .when(F.col("in_incoming"), F.lit("pending"))
        .otherwise(F.lit("missing"))
    )
    return (
        join_groups(rows, kept, "group_key", "n_children", total)
        .where("not in_store or created_ms > ms")
        .select(
            "ref_table", "ref_field", "row_key", status.alias("ref_status"),
            F.date_format(F.timestamp_millis(F.floor("ms").cast("long")), "yyyy-MM").alias("year_month"),
        )
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, status and month."""
    return orphans.groupBy("ref_table", "ref_field", "ref_status", "year_month").agg(
        F.count(F.lit(1)).alias("orphans")
    )
