"""Versioned Parquet tables with atomic commits.

A store is a folder with immutable Parquet parts and numbered version files.
A version lists, per table, its parts and its removals, each with the number of
the version that added it.  A commit writes all new parts first and then
names the next version file, which fails if another writer was faster; one
version covers all tables, so documents and points never drift apart.

Removals are tables of keys, applied to older parts by an anti-join when a
table is read: removing rows costs as much as naming them, not a rewrite.
``compact`` rewrites a table once there are many.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.runtime import maybe_broadcast
from vecspark.schema import KEYS, SCHEMAS


class Conflict(RuntimeError):
    """Another writer committed first."""


class Store:
    """The tables below a folder (any path Hadoop can write to)."""

    #: Columns of lookups, for Parquet's bloom filters.
    LOOKUPS = {"documents": ("document_id", "content_md5"), "points": ("point_id", "document_id")}

    def __init__(self, spark: SparkSession, root: str, *, bloom_filters: bool = False):
        """``bloom_filters``: write them for the columns of lookups, which
        spares large tables most row groups of a lookup by id or hash."""
        self.spark, self.root, self.bloom_filters = spark, root.rstrip("/"), bloom_filters
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def _versions(self) -> list[int]:
        at = self._path(f"{self.root}/_versions")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self) -> tuple[int, dict]:
        """The number and content of the current version."""
        versions = self._versions()
        if not versions:
            return 0, {}
        at = self._path(f"{self.root}/_versions/{versions[-1]:010d}.json")
        stream = self._fs.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return versions[-1], json.loads(text)

    def ensure(self, part: str) -> None:
        """Make a part's folder, which a write without rows may not have made."""
        self._fs.mkdirs(self._path(f"{self.root}/{part}"))

    def _publish(self, number: int, tables: dict) -> None:
        """Write the version aside and give it its name, which fails if it is
        taken: a reader sees all of a version or nothing."""
        at = self._path(f"{self.root}/_versions/{number:010d}.json")
        aside = self._path(f"{self.root}/_versions/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(tables, indent=1).encode()))
        out.close()
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else self._fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            files.rename(aside, at, sc._gateway.new_array(hadoop.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(aside, False)
            raise Conflict(f"version {number} exists already") from e

    # reading

    def tables(self) -> tuple[str, ...]:
        return tuple(sorted(self.state()[1]))

    def schema(self, table: str) -> T.StructType:
        return SCHEMAS[table]

    def read(self, table: str) -> DataFrame:
        """The current rows of a table (empty if it does not exist)."""
        schema = self.schema(table)
        entry = self.state()[1].get(table)
        if not entry or not entry["parts"]:
            return self.spark.createDataFrame([], schema)
        if not entry["removals"]:
            return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p['path']}" for p in entry["parts"]))
        key = KEYS[table]
        out = None
        # parts between two removals share their anti-join
        marks = sorted({r["version"] for r in entry["removals"]})
        for low, high in zip([0, *marks], [*marks, None]):
            parts = [p for p in entry["parts"] if p["version"] >= low and (high is None or p["version"] < high)]
            if not parts:
                continue
            rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{p['path']}" for p in parts))
            later = [r for r in entry["removals"] if high is not None and r["version"] >= high]
            if later:
                gone = self.spark.read.schema(T.StructType([schema[key]])).parquet(
                    *(f"{self.root}/{r['path']}" for r in later)
                )
                rows = rows.join(maybe_broadcast(gone, sum(r["rows"] for r in later)), key, "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], schema)

    # writing

    def commit(self, *, append: Mapping[str, DataFrame] | None = None, remove: Mapping[str, DataFrame] | None = None,
               create: tuple[str, ...] = (), drop: tuple[str, ...] = (), unique: bool = True) -> dict[str, int]:
        """One new version.  ``append``: rows per table, ``remove``: keys per
        table (a one-column table), applied before the appended rows.  Returns
        the number of appended rows.  With ``unique``, repeated keys are an
        error, within the rows and against the table."""
        number, tables = self.state()
        number += 1
        for table in drop:
            tables.pop(table, None)
        for table in create:
            tables.setdefault(table, {"parts": [], "removals": []})
        counts: dict[str, int] = {}
        for table, keys in (remove or {}).items():
            if table not in tables:
                continue
            path = f"{table}/removed-{number:010d}-{uuid.uuid4().hex}"
            keys.select(KEYS[table]).distinct().write.parquet(f"{self.root}/{path}")
            n = self.spark.read.parquet(f"{self.root}/{path}").count()
            if n:
                tables[table]["removals"].append({"path": path, "version": number, "rows": n})
        for table, rows in (append or {}).items():
            entry = tables.setdefault(table, {"parts": [], "removals": []})
            key = KEYS[table]
            schema = self.schema(table)
            path = f"{table}/part-{number:010d}-{uuid.uuid4().hex}"
            shaped = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema))
            required = [f.name for f in schema if not f.nullable]
            for c in required:
                shaped = shaped.withColumn(
                    c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(
                        F.raise_error(F.lit(f"{table}.{c} must not be null")).cast(schema[c].dataType)
                    )
                )
            # sorted by key, so that statistics of row groups help lookups
            self._write(table, shaped.sortWithinPartitions(key), path)
            new = self.spark.read.schema(schema).parquet(f"{self.root}/{path}")
            counts[table] = new.count()
            if unique and counts[table]:
                self._check_unique(table, key, new, (remove or {}).get(table))
            if counts[table]:
                entry["parts"].append({"path": path, "version": number, "rows": counts[table]})
        self._publish(number, tables)
        return counts

    def _write(self, table: str, rows: DataFrame, path: str) -> None:
        writer = rows.write
        if self.bloom_filters:
            writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
            for c in self.LOOKUPS.get(table, ()):
                writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.root}/{path}")

    def _check_unique(self, table: str, key: str, new: DataFrame, removed: DataFrame | None) -> None:
        if new.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{table}: {key} repeats within the rows")
        old = self.read(table).select(key)
        if removed is not None:
            old = old.join(removed.select(key), key, "left_anti")
        if new.select(key).join(old, key, "left_semi").limit(1).count():
            raise ValueError(f"{table}: {key} exists already")

    def compact(self, table: str) -> None:
        """Rewrite a table without its removed rows, as one part."""
        number, tables = self.state()
        entry = tables[table]
        rows = self.read(table)
        path = f"{table}/part-{number + 1:010d}-{uuid.uuid4().hex}"
        key = KEYS[table]
        self._write(table, rows.repartitionByRange(key).sortWithinPartitions(key), path)
        n = self.spark.read.schema(self.schema(table)).parquet(f"{self.root}/{path}").count()
        entry["parts"] = [{"path": path, "version": number + 1, "rows": n}] if n else []
        entry["removals"] = []
        self._publish(number + 1, tables)
