"""Vector expressions.

``cosine`` stays in the JVM (for one query vector); batches of queries are
scored by blocks of matrix products in ``operators.search``.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(v: Column, q: Column) -> Column:
    """Cosine similarity in double precision.  NaN for a zero norm, null for a
    null vector or a null element, an error for unequal lengths."""
    lengths = norm(v) * norm(q)
    value = F.when(lengths == 0, F.lit(float("nan"))).otherwise(dot(v, q) / F.nullif(lengths, F.lit(0.0)))
    return F.when(F.size(v) == F.size(q), value).when(
        F.size(v) != F.size(q),
        F.raise_error(F.concat(F.lit("vectors of unequal lengths: "), F.size(v), F.lit(" and "), F.size(q))).cast("double"),
    )


def literal(vector: list[float] | np.ndarray) -> Column:
    """A query vector narrowed to float32, as a constant."""
    return F.lit([float(np.float32(x)) for x in vector]).cast("array<float>")


def checked(v: Column, dim: int) -> Column:
    """``v`` as array<float>; an error unless it has ``dim`` elements."""
    return F.when(v.isNull() | (F.size(v) == dim), v.cast("array<float>")).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(v))).cast("array<float>")
    )


def encode_base64(vector: list[float] | np.ndarray) -> str:
    """Base64 of little-endian float32."""
    return base64.b64encode(np.asarray(vector, "<f4").tobytes()).decode("ascii")


def decode_base64(text: str) -> list[float]:
    """The inverse; ValueError if the bytes are no whole floats."""
    raw = base64.b64decode(text, validate=True)
    if len(raw) % 4:
        raise ValueError("not a whole number of float32 values")
    return np.frombuffer(raw, "<f4").astype(float).tolist()


@F.arrow_udf(T.BinaryType())
def _packed(v: pa.Array) -> pa.Array:
    """The bytes of each list of floats, taken over as they are."""
    n, values = len(v), v.flatten()
    sizes = np.asarray(v.value_lengths().fill_null(0))
    data = values.to_numpy(zero_copy_only=False).astype("<f4")
    offsets = np.concatenate(([0], np.cumsum(sizes))) * 4
    mask = pa.array(np.asarray(v.is_valid())) if v.null_count else None
    valid = mask.buffers()[1] if mask is not None else None
    return pa.Array.from_buffers(pa.binary(), n, [valid, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _unpacked(c: pa.Array) -> pa.Array:
    """The lists of floats in binary values of whole floats."""
    sizes = np.asarray(pc.binary_length(c).fill_null(0))
    data = np.frombuffer(b"".join(x for x in c.to_pylist() if x), "<f4")
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes // 4))).astype(np.int32), mask=np.append(~np.asarray(c.is_valid()), False))
    return pa.ListArray.from_arrays(offsets, pa.array(data))


def vector_to_base64(v: Column) -> Column:
    """Base64 of little-endian float32; null for null."""
    return F.translate(F.base64(_packed(v.cast("array<float>"))), "\r\n", "")  # Spark breaks lines


def base64_to_vector(c: Column) -> Column:
    """array<float> of a base64 column; null where it does not decode."""
    raw = F.try_to_binary(c, F.lit("base64"))
    return _unpacked(F.when(F.length(raw) % 4 == 0, raw))
