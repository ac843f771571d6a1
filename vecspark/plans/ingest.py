"""The plan of adding documents: sanitize, chunk, drop what is stored, embed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.embed import Embedder, embed
from vecspark.functions import text
from vecspark.functions.chunk import chunk_documents
from vecspark.functions.ids import id_column
from vecspark.runtime import write


def sanitized(docs: DataFrame, strict: bool = True) -> DataFrame:
    """Hash and name by the content; blank contents are an error (``strict``)
    or left out."""
    content = F.col("content")
    if strict:
        content = F.when(~text.is_blank(content), content).otherwise(
            F.raise_error(F.lit("a document's content must not be blank")).cast("string")
        )
    else:
        docs = docs.where(~text.is_blank(content))
    return docs.withColumn("content", content).withColumns({
        "name": F.coalesce(text.str_or_none(F.col("name")), text.default_name(F.col("content"))),
        "content_md5": text.content_md5(F.col("content")),
    })


def not_stored(docs: DataFrame, stored: DataFrame, within_batch: bool = False) -> DataFrame:
    """Documents whose content is not stored yet: one anti-join.  Equal new
    ones all stay unless ``within_batch``."""
    fresh = docs.join(stored.select("content_md5").distinct(), "content_md5", "left_anti")
    return fresh.dropDuplicates(["content_md5"]) if within_batch else fresh


def ingest(docs: DataFrame, stored: DataFrame, model: Embedder, *, lines: int = 20, tokens: int = 500, count=None,
           ignore_same_content: bool = True, dedupe_within_batch: bool = False, link_parent: bool = False,
           batch_size: int = 100) -> tuple[DataFrame, DataFrame, int]:
    """(new documents, their points, number of ignored chunks).  Both tables
    are written once, as ids must not be made again."""
    from vecspark.functions.chunk import count_words

    chunks = write(
        chunk_documents(sanitized(docs), lines=lines, tokens=tokens, count=count or count_words, link_parent=link_parent),
        "chunks",
    ).df
    new = not_stored(chunks, stored, dedupe_within_batch) if ignore_same_content else chunks
    new = write(new.select(*chunks.columns), "new-documents").df
    ignored = chunks.count() - new.count()
    points = embed(
        new.select("document_id", "content_md5", "content", F.lit("{}").alias("metadata")), "content", model, batch_size
    ).select(id_column("point").alias("point_id"), "document_id", "content_md5", "embedding", "metadata")
    return new, write(points, "new-points").df, ignored
