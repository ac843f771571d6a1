"""The engine: add, search and remove documents of a store."""

from __future__ import annotations

import asyncio
import json
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.embed import Embedder
from vecspark.functions.chunk import count_words
from vecspark.models import Document, Manifest, Point, SearchRequest
from vecspark.operators import search as ops
from vecspark.plans.ingest import ingest
from vecspark.schema import DOCUMENT_SCHEMA, DOCUMENTS, POINTS
from vecspark.sources.store import Store
from vecspark.tables import Database


class Engine:
    """A store of documents and their vectors.

    ``path``: a folder that all executors can reach; ``model``: an Embedder.
    The model has to be the one in the store's manifest.
    """

    def __init__(self, path: str, model: Embedder, *, spark: SparkSession | None = None, count_tokens=count_words,
                 verbose: bool = False):
        if not path:
            raise ValueError("a path is needed")
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.model, self.count_tokens, self.verbose = model, count_tokens, verbose
        self.db = Database(Store(self.spark, str(path)))
        self.db.touch()
        self.manifest = self._reconciled()

    def _reconciled(self) -> Manifest:
        stored = self.db.manifest.receive()
        if stored is None:
            if not getattr(self.model, "dimensions", None):
                raise ValueError("the model does not say how many dimensions it has")
            return self.db.manifest.create(Manifest(self.model.name, self.model.dimensions))
        if stored.embedding_model != self.model.name:
            raise ValueError(f"the store was made with model {stored.embedding_model!r}, not {self.model.name!r}")
        if not getattr(self.model, "dimensions", None):
            self.model.dimensions = stored.embedding_dimensions
        elif stored.embedding_dimensions != self.model.dimensions:
            raise ValueError(f"the store has {stored.embedding_dimensions} dimensions, not {self.model.dimensions}")
        return stored

    def add(self, documents: Document | str | Iterable[Document | str] | DataFrame, *, batch_size: int = 100,
            ignore_same_content: bool = True, lines_per_chunk: int = 20, tokens_per_chunk: int = 500,
            dedupe_within_batch: bool = False, link_parent: bool = False) -> dict[str, Any]:
        """Add texts, documents or a table of documents; one commit for both
        tables, so a failure leaves nothing behind."""
        if isinstance(documents, DataFrame):
            rows = documents
            for f in DOCUMENT_SCHEMA:
                if f.name not in rows.columns:
                    fill = {"source_id": F.lit(""), "metadata": F.lit("{}"), "document_id": F.lit("")}.get(f.name)
                    if f.name in ("created_at", "updated_at"):
                        fill = F.unix_timestamp()
                    rows = rows.withColumn(f.name, (fill if fill is not None else F.lit(None)).cast(f.dataType))
        else:
            made = Document.from_contents(documents)
            rows = self.spark.createDataFrame([d.row() for d in made], DOCUMENT_SCHEMA)
        new, points, ignored = ingest(
            rows, self.db.documents.frame(), self.model, lines=lines_per_chunk, tokens=tokens_per_chunk,
            count=self.count_tokens, ignore_same_content=ignore_same_content, dedupe_within_batch=dedupe_within_batch,
            link_parent=link_parent, batch_size=batch_size,
        )
        counts = self.db.store.commit(append={DOCUMENTS: new, POINTS: points})
        return {
            "success": True, "created_documents": counts[DOCUMENTS], "ignored_documents": ignored,
            "created_points": counts[POINTS], "error": None,
        }

    def remove(self, doc_ids: str | Iterable[str]) -> None:
        """Remove documents and their points in one commit; ids that do not
        exist are passed over."""
        ids = [doc_ids] if isinstance(doc_ids, str) else list(doc_ids)
        if not ids:
            return
        gone = self.spark.createDataFrame([(i,) for i in ids], "document_id string")
        points = self.db.points.frame().join(gone, "document_id", "left_semi").select("point_id")
        documents = self.db.documents.frame().join(gone, "document_id", "left_semi").select("document_id")
        self.db.store.commit(remove={POINTS: points, DOCUMENTS: documents})

    def search_frame(self, query: str | Sequence[float] | SearchRequest, top_k: int = 3, *,
                     with_embedding: bool = False) -> DataFrame:
        """The search as a DataFrame (point, document, relevance_score)."""
        if isinstance(query, SearchRequest):
            request = query
        else:
            if isinstance(query, str) and not query.strip():
                raise ValueError("the query must not be empty")
            request = SearchRequest(query, top_k, with_embedding)
        vector = SearchRequest.to_vectors(request, self.model)[0]
        found = ops.search(self.db.points.frame(), self.db.documents.frame(), vector, request.top_k,
                           with_embedding=request.with_embedding)
        if self.verbose:
            found.explain("formatted")
        return found

    def search(self, query: str | Sequence[float] | SearchRequest, top_k: int = 3, *,
               with_embedding: bool = False) -> list[tuple[Point, Document, float]]:
        rows = self.search_frame(query, top_k, with_embedding=with_embedding).collect()
        return [(Point.of(r["point"]), Document.of(r["document"]), r["relevance_score"]) for r in rows]

    async def asearch(self, query: str | Sequence[float] | SearchRequest, top_k: int = 3, *,
                      with_embedding: bool = False) -> list[tuple[Point, Document, float]]:
        return await asyncio.to_thread(self.search, query, top_k, with_embedding=with_embedding)

    def search_many(self, requests: DataFrame, k: int = 5) -> DataFrame:
        """Ranked points of many requests (request_id, query_vector, top_k)."""
        return ops.batch_top_k(self.db.points.frame(), requests, k=k, dim=self.manifest.embedding_dimensions)

    def describe(self) -> str:
        return json.dumps({"tables": self.db.show_table_names(), "manifest": vars(self.manifest)})
