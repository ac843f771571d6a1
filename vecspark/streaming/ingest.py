"""Streaming ingest: every micro-batch goes through the engine's plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecspark.engine import Engine


def add_stream(engine: Engine, documents: DataFrame, checkpoint: str, *, available_now: bool = True,
               interval: str = "1 minute", **options) -> StreamingQuery:
    """Add a stream of documents to a store.  A batch that is tried again after
    a failure adds nothing twice: what it had committed is stored, and stored
    contents are ignored."""

    def batch(rows: DataFrame, _: int) -> None:
        if rows.limit(1).count():
            engine.add(rows, ignore_same_content=True, **options)

    writer = documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
