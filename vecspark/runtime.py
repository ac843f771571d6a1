"""Session helpers shared by all operators: written intermediate tables,
size-checked broadcasts and joins that survive a hot key."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a broadcast side may have; every use counts the side first.
BROADCAST_ROWS = 1_000_000
#: A key is hot when it holds more than one in this many rows, so that there
#: are at most this many hot keys, whatever the input's size.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is
    unset and all executors are this machine (tests) a temporary folder takes
    its place; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="vecspark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Written:
    """An intermediate table written to the shared folder, which cuts lineage
    and outlives the executors that wrote it."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self._spark, self.path, self._schema = spark, path, schema

    @property
    def df(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only once nothing lazy reads them any more."""
        hadoop = self._spark.sparkContext._jsc.hadoopConfiguration()
        path = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(hadoop).delete(path, True)


_WRITTEN: list[Written] = []


@atexit.register
def _clean() -> None:
    """Delete this session's intermediate tables, as far as Spark still runs."""
    for w in _WRITTEN:
        with contextlib.suppress(Exception):
            w.drop()


def write(df: DataFrame, name: str) -> Written:
    """Write ``df`` as Parquet below the shared folder; the files are deleted
    when the session's Python process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = Written(spark, path, df.schema)
    _WRITTEN.append(written)
    return written


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` stay within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


#: Words of a bitmap of keys: the rows that ``maybe_in`` broadcasts at most.
BITMAP_WORDS = 1 << 20


def _bit(key: str) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    return F.shiftrightunsigned(h, 65 - BITMAP_WORDS.bit_length()), one


def maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``keys``.

    A bitmap of hashes of a fixed size is broadcast, whatever the number of
    keys: no row of a key is lost, and the share of other rows that stay grows
    with the number of keys (4 % at 3 million).  Whoever needs just the rows of
    the keys joins what is left: by an inner join to distinct keys, as the
    optimizer puts a semi-join before the bitmap.
    """
    word, bit = _bit(key)
    bits = keys.select(word.alias("_word"), bit.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    met = rows.withColumns({"_at": word, "_bit": bit}).join(F.broadcast(bits), F.col("_at") == F.col("_word"))
    return met.where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).drop("_at", "_bit", "_word", "_bits")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of many ``rows`` to one-row-per-key ``groups``.

    ``groups`` has the group's number of rows in column ``size``, ``total`` is
    the sum over all groups.  Groups above ``total / HOT_SHARE`` rows (at most
    HOT_SHARE of them) are broadcast, so that no task receives a hot group;
    the others meet their rows in a plain shuffle join.
    """
    limit = max(10_000, total // HOT_SHARE)
    hot = groups.where(F.col(size) > limit)
    if total <= limit or not hot.limit(1).count():
        return rows.join(groups, key)
    cold = groups.where(F.col(size) <= limit)
    hot_keys = hot.select(key)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot_keys), key, "left_anti").join(cold, key)
    )


def join_salted(links: DataFrame, rows: DataFrame, key: str, by: str, total: int, salts: int = 64) -> DataFrame:
    """Inner join of ``links`` (any number per key) to many ``rows`` per key.

    Keys with more than one in HOT_SHARE of the ``total`` rows (so at most
    HOT_SHARE keys, which are broadcast) are spread over ``salts`` tasks by a
    hash of column ``by``; their links are sent to each of these.
    """
    limit = max(10_000, total // HOT_SHARE)
    if total <= limit:
        return links.join(rows, key)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(key, F.lit(True).alias("_hot"))
    hot = F.broadcast(write(hot, "hot-keys").df)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(0)
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = links.join(hot, key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    right = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")


def python_space() -> str:
    """The characters of ``str.isspace``, for a Java character class."""
    return (
        r"\u0009-\u000d\u001c-\u0020\u0085\u00a0\u1680\u2000-\u200a"
        r"\u2028\u2029\u202f\u205f\u3000"
    )


def strip(c: Column) -> Column:
    """``str.strip`` of Python, which also removes non-ASCII white space."""
    ws = python_space()
    return F.regexp_replace(c, f"^[{ws}]+|[{ws}]+$", "")
