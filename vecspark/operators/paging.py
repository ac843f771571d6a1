"""Filters, keyset pages and counts."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conjunction(**equal: Any) -> Column | None:
    """AND of equalities; values of None are left out."""
    parts = [F.col(c) == F.lit(v) for c, v in equal.items() if v is not None]
    return functools.reduce(operator.and_, parts) if parts else None


def filtered(df: DataFrame, **equal: Any) -> DataFrame:
    where = conjunction(**equal)
    return df if where is None else df.where(where)


def keyset(df: DataFrame, key: str, *, after: str | None = None, before: str | None = None, limit: int = 20,
           order: str = "asc", **equal: Any) -> DataFrame:
    """One page and a row more: ``after`` counts in ascending, ``before`` in
    descending order; the other is ignored.  Filters reach the scan, and only
    ``limit`` + 1 rows leave each task."""
    if order not in ("asc", "desc"):
        raise ValueError(f"order must be asc or desc, not {order!r}")
    if limit < 0:
        raise ValueError("limit must not be negative")
    out = filtered(df, **equal)
    if order == "asc" and after is not None:
        out = out.where(F.col(key) > F.lit(after))
    if order == "desc" and before is not None:
        out = out.where(F.col(key) < F.lit(before))
    by = F.asc_nulls_last(key) if order == "asc" else F.desc_nulls_last(key)
    return out.orderBy(by).limit(limit + 1)


@dataclass
class Page:
    """A page of records."""

    data: list[Any] = field(default_factory=list)
    first_id: str | None = None
    last_id: str | None = None
    has_more: bool = False
    object: str = "list"

    @classmethod
    def of(cls, rows: list[Any], key: str, limit: int) -> Page:
        data = rows[:limit]
        ids = [getattr(r, key) for r in data]
        return cls(data, ids[0] if ids else None, ids[-1] if ids else None, len(rows) > limit)
