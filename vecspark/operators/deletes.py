"""Predicates of deletions, null-safe: a null never matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_in(**values: Sequence[str] | None) -> Column:
    """OR of ``column IN values``; None and empty lists match nothing."""
    out: Column = F.lit(False)
    for c, v in values.items():
        if v:
            out = out | F.coalesce(F.col(c).isin(list(v)), F.lit(False))
    return out


def outdated(document_id: str, content_md5: str, *, key: str = "document_id") -> Column:
    """Points of a document that were made from other content."""
    return F.coalesce((F.col(key) == document_id) & (F.col("content_md5") != content_md5), F.lit(False))
