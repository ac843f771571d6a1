"""Shared handling of embedding columns for the vector operators.

A usable embedding is not null, has the given number of elements, none of them
null, NaN or infinite, and is not all zero.  Vectors travel as the bytes of
their unit vector (float32).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.words import mix


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The float32 matrix in a binary column of ``dim`` floats each."""
    n = len(column)
    if not n:
        return np.empty((0, dim), np.float32)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.float32, n * dim, int(offsets[0])).reshape(n, dim)


def binary(rows: np.ndarray) -> pa.Array:
    """A binary column of a float32 matrix's rows."""
    n, dim = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * (dim * 4)
    data = np.ascontiguousarray(rows, np.float32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    bits = (rows + np.float32(0)).view(np.uint32).astype(np.uint64)  # + 0 makes -0.0 and 0.0 one
    h = np.full(len(rows), 7, np.uint64)
    for j in range(bits.shape[1]):
        h = mix(h * np.uint64(3) + bits[:, j])
    return h


def unit_vectors(df: DataFrame, vector_col: str, keep: list[str], dim: int) -> DataFrame:
    """``keep``, ``cls`` (hash of the unit vector) and ``vec`` of usable rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(b.num_columns - 1)
            size = np.asarray(v.value_lengths().fill_null(-1))
            rows = np.flatnonzero(size == dim)
            if not len(rows):
                continue
            flat = v.take(pa.array(rows)).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
            norm = np.sqrt((x * x).sum(1))  # a null has become NaN
            ok = np.isfinite(norm) & (norm > 0)
            unit = (x[ok] / norm[ok, None]).astype(np.float32)
            at = pa.array(rows[ok])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(at) for k in range(len(keep))),
                 pa.array(_hash_rows(unit).view(np.int64)), binary(unit)],
                [*keep, "cls", "vec"],
            )

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "cls long", "vec binary"])
    return df.select(*keep, F.col(vector_col).cast("array<float>").alias("_v")).mapInArrow(run, schema)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """k-means of a small matrix of unit vectors on the driver (index fitting)."""
    rng = np.random.RandomState(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        order = np.argsort(own, kind="stable")
        counts = np.bincount(own, minlength=k)
        has = counts > 0
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        sums = np.add.reduceat(x[order], starts[has])
        c = c.copy()
        c[has] = unit(sums)
        if not has.all():  # an empty centre moves to a random row
            c[~has] = x[rng.choice(len(x), int((~has).sum()))]
    return c.astype(np.float32)
