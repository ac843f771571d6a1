"""Exact top-k cosine search, for one query and for many.

One query: a JVM expression, a top-k that each task applies to its own rows
(TakeOrderedAndProject), then a join of the k rows to the documents.  The limit
comes before the join, so points without a document use up places.

Many queries: points are scanned once for as many queries as a task can hold;
every task multiplies its points by blocks of queries, carries its own k best per
query through all of its batches, and only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vecspark.functions import vectors

#: Elements of query vectors that are held by every task at a time.
QUERY_ELEMENTS = 1 << 22


def top_k(points: DataFrame, vector: list[float], k: int, *, id_col: str = "point_id",
          vector_col: str = "embedding") -> DataFrame:
    """The k best rows with ``relevance_score``; NaN counts as largest, ties go
    to the smaller id.  Zero gives no rows, negative is an error."""
    if k < 0:
        raise ValueError("top_k must not be negative")
    scored = points.where(F.col(vector_col).isNotNull()).withColumn(
        "relevance_score", vectors.cosine(F.col(vector_col), vectors.literal(vector))
    )
    return scored.orderBy(F.desc("relevance_score"), F.asc(id_col)).limit(k)


def search(points: DataFrame, documents: DataFrame, vector: list[float], k: int, *,
           with_embedding: bool = False) -> DataFrame:
    """Rows (point struct, document struct, relevance_score), best first."""
    best = top_k(points, vector, k)
    shown = [c for c in points.columns if with_embedding or c != "embedding"]
    hits = best.select(
        F.col("document_id"), F.struct(*shown).alias("point"), "relevance_score"
    )
    # k rows: their number is the caller's own bound
    return (
        documents.select("document_id", F.struct(*documents.columns).alias("document"))
        .join(F.broadcast(hits) if k <= 10_000 else hits, "document_id")
        .select("point", "document", "relevance_score")
        .orderBy(F.desc("relevance_score"), F.asc("point.point_id"))
    )


class _Best:
    """The best points of every query that one task has seen; a point that
    comes twice counts once, ties go to the smaller id."""

    def __init__(self, ks: np.ndarray):
        self.ks, self.bound = ks, np.full(len(ks), -np.inf)
        self.frame, self.new, self.rows = None, [], 0

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries from ``first`` on with points ``ids``."""
        q, i = np.nonzero(scores >= self.bound[first : first + len(scores), None])
        if len(q):
            self.new.append(pd.DataFrame({"q": q + first, "id": ids[i], "s": scores[q, i]}))
            self.rows += len(q)
            if self.rows > 1 << 20:
                self.kept()

    def kept(self) -> pd.DataFrame:
        parts = [*([] if self.frame is None else [self.frame]), *self.new]
        every = pd.concat(parts) if parts else pd.DataFrame({"q": np.empty(0, np.int64), "id": [], "s": np.empty(0)})
        every["r"] = -every["s"].round(9)
        every = every.sort_values(["q", "r", "id"], kind="stable").drop_duplicates(["q", "id"])
        rank = every.groupby("q").cumcount().to_numpy()
        every = every[rank < self.ks[every["q"]]].drop(columns="r")
        full = every.groupby("q")["s"].agg(["size", "min"])
        full = full[full["size"].to_numpy() >= self.ks[full.index]]
        self.bound[full.index] = full["min"] - 1e-8  # ties are decided on rounded scores
        self.frame, self.new, self.rows = every, [], 0
        return every


def batch_top_k(points: DataFrame, queries: DataFrame, *, id_col: str = "point_id", vector_col: str = "embedding",
                query_id: str = "request_id", query_col: str = "query_vector", k_col: str | None = "top_k",
                k: int = 5, dim: int = 64) -> DataFrame:
    """(query_id, rank_no, id, relevance_score) of the best points of every
    query.  Only vectors of ``dim`` finite elements and a positive norm take
    part; a query's own ``k_col`` counts where it is positive, else ``k``."""

    def usable(c: str) -> object:
        bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return F.col(c).isNotNull() & (F.size(c) == dim) & ~bad & F.exists(c, lambda x: x != 0)

    asks = queries.where(usable(query_col)).select(
        F.col(query_id).alias("q"), F.col(query_col).alias("v"),
        F.when(F.col(k_col) > 0, F.col(k_col)).otherwise(F.lit(k)).alias("k") if k_col else F.lit(k).alias("k"),
    )
    base = points.where(usable(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    id_type = base.schema["id"].dataType.simpleString()
    q_type = asks.schema["q"].dataType.simpleString()
    total = asks.count()
    found = None
    parts = max(1, -(-total * dim // QUERY_ELEMENTS))
    for part in range(parts):
        # a bounded block of queries, by hash; every block is one more scan
        rows = asks.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).collect()
        names = pa.array([r["q"] for r in rows])
        ks = np.array([r["k"] for r in rows], np.int64)
        qv = np.array([r["v"] for r in rows], np.float64).reshape(-1, dim)
        qv = qv / np.maximum(np.linalg.norm(qv, axis=1, keepdims=True), 1e-300)

        def run(batches: Iterator[pa.RecordBatch], names=names, ks=ks, qv=qv) -> Iterator[pa.RecordBatch]:
            if not len(qv):
                return
            best = _Best(ks)
            for b in batches:
                ids = b.column(0).to_pandas().to_numpy()
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                for a in range(0, len(qv), 256):
                    for m in range(0, len(x), 4096):
                        best.add(a, qv[a : a + 256] @ x[m : m + 4096].T, ids[m : m + 4096])
            kept = best.kept()
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(kept["q"].to_numpy())), pa.array(ks[kept["q"]], pa.int32()),
                 pa.array(kept["id"]).cast(b_type), pa.array(kept["s"].to_numpy())],
                ["q", "k", "id", "s"],
            )

        b_type = to_arrow_type(base.schema["id"].dataType)
        one = base.mapInArrow(run, f"q {q_type}, k int, id {id_type}, s double")
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy("q").orderBy(F.desc(F.round("s", 9)), F.asc("id"))
    return (
        found.dropDuplicates(["q", "id"]).withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= F.col("k"))
        .select(F.col("q").alias(query_id), "rank_no", F.col("id").alias(id_col), F.col("s").alias("relevance_score"))
    )
