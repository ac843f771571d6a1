"""The tables of a store as objects: create, read, list, count, remove."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.errors import NotFoundError
from vecspark.models import Document, Manifest, Point
from vecspark.operators import deletes, paging
from vecspark.runtime import maybe_broadcast
from vecspark.schema import DOCUMENT_SCHEMA, DOCUMENTS, MANIFEST, MANIFEST_SCHEMA, POINT_SCHEMA, POINTS
from vecspark.sources.store import Store

#: Ids that a lookup names in a filter, which reaches the scan; more are joined.
LISTED_IDS = 1000


class _Table:
    table: str
    key: str

    def __init__(self, store: Store):
        self.store = store

    def touch(self) -> bool:
        """Create the table; False if it was there."""
        if self.table in self.store.tables():
            return False
        self.store.commit(create=(self.table,))
        return True

    def frame(self) -> DataFrame:
        """The current rows."""
        return self.store.read(self.table)

    def drop(self, *, force: bool = False, touch_after_drop: bool = True) -> None:
        """Drop the table; only with ``force``."""
        if not force:
            raise ValueError("dropping a table needs force=True")
        self.store.commit(drop=(self.table,), create=(self.table,) if touch_after_drop else ())

    def _remove_where(self, where: Any) -> None:
        keys = self.frame().where(where).select(self.key)
        if keys.limit(1).count():
            self.store.commit(remove={self.table: keys})

    def count(self, **equal: Any) -> int:
        return paging.filtered(self.frame(), **equal).count()


class Documents(_Table):
    table, key = DOCUMENTS, "document_id"

    def retrieve(self, document_id: str) -> Document:
        rows = self.frame().where(F.col("document_id") == document_id).limit(1).collect()
        if not rows:
            raise NotFoundError(f"no document {document_id!r}")
        return Document.of(rows[0])

    def retrieve_many(self, document_ids: Sequence[str]) -> list[Document]:
        """The documents of these ids that exist, in the order of their ids."""
        ids = list(dict.fromkeys(document_ids))
        if not ids:
            return []
        if len(ids) <= LISTED_IDS:
            found = self.frame().where(F.col("document_id").isin(ids))
        else:
            wanted = self.store.spark.createDataFrame([(i,) for i in ids], "document_id string")
            found = self.frame().join(maybe_broadcast(wanted, len(ids)), "document_id", "left_semi")
        return [Document.of(r) for r in found.orderBy("document_id").collect()]

    def create(self, document: Document | Mapping[str, Any]) -> Document:
        return self.bulk_create([document])[0]

    def bulk_create(self, documents: Sequence[Document | Mapping[str, Any]]) -> list[Document]:
        made = [Document.of(d) for d in documents]
        if made:
            self.append(self.store.spark.createDataFrame([d.row() for d in made], DOCUMENT_SCHEMA))
        return made

    def append(self, rows: DataFrame) -> int:
        """Append a table of rows, at any scale."""
        return self.store.commit(append={self.table: rows})[self.table]

    def remove(self, document_id: str) -> None:
        """Remove a document; silent if it does not exist."""
        self._remove_where(F.col("document_id") == document_id)

    def list(self, *, content_md5: str | None = None, source_id: str | None = None, after: str | None = None,
             before: str | None = None, limit: int = 20, order: str = "asc") -> paging.Page:
        rows = paging.keyset(self.frame(), self.key, after=after, before=before, limit=limit, order=order,
                             content_md5=content_md5, source_id=source_id).collect()
        return paging.Page.of([Document.of(r) for r in rows], self.key, limit)

    def gen(self, *, content_md5: str | None = None, source_id: str | None = None, after: str | None = None,
            before: str | None = None, limit: int = 20, order: str = "asc") -> Iterator[Document]:
        """All documents in order, page by page."""
        while True:
            page = self.list(content_md5=content_md5, source_id=source_id, after=after, before=before, limit=limit, order=order)
            yield from page.data
            if not page.has_more or not page.data:
                return
            after, before = (page.last_id, before) if order == "asc" else (after, page.last_id)

    def count(self, *, document_id: str | None = None, content_md5: str | None = None) -> int:
        return super().count(document_id=document_id, content_md5=content_md5)

    def content_exists(self, content_md5: str) -> bool:
        return bool(self.frame().where(F.col("content_md5") == content_md5).limit(1).count())


class Points(_Table):
    table, key = POINTS, "point_id"

    def _shown(self, with_embedding: bool) -> DataFrame:
        f = self.frame()
        return f if with_embedding else f.drop("embedding")

    def retrieve(self, point_id: str, *, with_embedding: bool = False) -> Point:
        rows = self._shown(with_embedding).where(F.col("point_id") == point_id).limit(1).collect()
        if not rows:
            raise NotFoundError(f"no point {point_id!r}")
        return Point.of(rows[0])

    def create(self, point: Point | Mapping[str, Any]) -> Point:
        return self.bulk_create([point])[0]

    def bulk_create(self, points: Sequence[Point | Mapping[str, Any]], *, batch_size: int = 100) -> list[Point]:
        """All points in one commit; each needs an embedding.  ``batch_size``
        is accepted for symmetry: rows travel in Arrow batches."""
        del batch_size
        made = [Point.of(p) for p in points]
        if any(not p.is_embedded for p in made):
            raise ValueError("all points must have an embedding")
        if made:
            self.append(self.store.spark.createDataFrame([p.row() for p in made], POINT_SCHEMA))
        return made

    def append(self, rows: DataFrame) -> int:
        return self.store.commit(append={self.table: rows})[self.table]

    def remove(self, point_id: str) -> None:
        self._remove_where(F.col("point_id") == point_id)

    def remove_outdated(self, *, document_id: str, content_md5: str) -> None:
        self._remove_where(deletes.outdated(document_id, content_md5))

    def remove_many(self, point_ids: Sequence[str] | None = None, *, document_ids: Sequence[str] | None = None,
                    content_md5s: Sequence[str] | None = None) -> None:
        """Remove points that match any list; empty lists match nothing."""
        if point_ids or document_ids or content_md5s:
            self._remove_where(deletes.any_in(point_id=point_ids, document_id=document_ids, content_md5=content_md5s))

    def list(self, *, document_id: str | None = None, content_md5: str | None = None, after: str | None = None,
             before: str | None = None, limit: int = 20, order: str = "asc", with_embedding: bool = False) -> paging.Page:
        rows = paging.keyset(self._shown(with_embedding), self.key, after=after, before=before, limit=limit, order=order,
                             document_id=document_id, content_md5=content_md5).collect()
        return paging.Page.of([Point.of(r) for r in rows], self.key, limit)

    def gen(self, *, document_id: str | None = None, content_md5: str | None = None, after: str | None = None,
            before: str | None = None, limit: int = 20, order: str = "asc", with_embedding: bool = False) -> Iterator[Point]:
        while True:
            page = self.list(document_id=document_id, content_md5=content_md5, after=after, before=before, limit=limit,
                             order=order, with_embedding=with_embedding)
            yield from page.data
            if not page.has_more or not page.data:
                return
            after, before = (page.last_id, before) if order == "asc" else (after, page.last_id)

    def count(self, *, document_id: str | None = None, content_md5: str | None = None) -> int:
        return super().count(document_id=document_id, content_md5=content_md5)

    def content_exists(self, content_md5: str) -> bool:
        return bool(self.frame().where(F.col("content_md5") == content_md5).limit(1).count())


def first_manifest(rows: DataFrame) -> DataFrame:
    """The manifest that counts, if a table holds several."""
    return rows.orderBy("name").limit(1)


class Manifests(_Table):
    table, key = MANIFEST, "name"

    def receive(self) -> Manifest | None:
        rows = first_manifest(self.frame()).collect()
        return Manifest(**rows[0].asDict()) if rows else None

    def create(self, manifest: Manifest | Mapping[str, Any]) -> Manifest:
        """The store's only manifest; an error if there is one."""
        made = manifest if isinstance(manifest, Manifest) else Manifest(**manifest)
        if self.receive() is not None:
            raise ValueError("the store has a manifest already")
        rows = self.store.spark.createDataFrame([json.loads(json.dumps(vars(made)))], MANIFEST_SCHEMA)
        self.store.commit(append={self.table: rows})
        return made

    def drop(self) -> None:  # the manifest may always be dropped
        self.store.commit(drop=(self.table,))


class Database:
    """All tables of a store."""

    def __init__(self, store: Store):
        self.store = store
        self.manifest, self.documents, self.points = Manifests(store), Documents(store), Points(store)

    def touch(self) -> bool:
        """Create what is missing, in one commit."""
        missing = tuple(t for t in (MANIFEST, DOCUMENTS, POINTS) if t not in self.store.tables())
        if missing:
            self.store.commit(create=missing)
        return bool(missing)

    def show_table_names(self) -> tuple[str, ...]:
        return self.store.tables()
