"""Embedding models as the engine sees them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.runtime import write


class Embedder(Protocol):
    """What a model has to offer; it is pickled and used on executors."""

    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One float row per text."""


class HashingEmbedder:
    """Deterministic feature hashing of words and letter triples, L2-normed;
    needs no network and no training."""

    def __init__(self, dimensions: int = 64, name: str = "hashing"):
        self.name, self.dimensions = name, dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                for g in (w, *(w[j : j + 3] for j in range(len(w) - 2))):
                    h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
                    out[i, h % self.dimensions] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def embed(df: DataFrame, text_col: str, model: Embedder, batch_size: int = 100) -> DataFrame:
    """``df`` with a column ``embedding``; texts go to the model in batches."""
    names = [c for c in df.columns if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch_size):
                part = b.slice(at, batch_size)
                rows = np.asarray(model.embed(part.column(names.index(text_col)).to_pylist()), np.float32)
                if rows.shape != (part.num_rows, model.dimensions):
                    raise ValueError(f"the model gave {rows.shape} for {part.num_rows} texts of {model.dimensions} dimensions")
                offsets = np.arange(part.num_rows + 1, dtype=np.int32) * model.dimensions
                vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], [*names, "embedding"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.select(*names).dtypes)
    return df.select(*names).mapInArrow(run, f"{schema}, embedding array<float>")


def embed_cached(df: DataFrame, text_col: str, md5_col: str, model: Embedder, cache_path: str) -> DataFrame:
    """Like ``embed``, but texts whose hash is in the Parquet cache of this
    model are not embedded again; new vectors are appended to it."""
    spark = df.sparkSession
    at = f"{cache_path.rstrip('/')}/model={model.name}-{model.dimensions}"
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    if path.getFileSystem(hadoop).exists(path):
        known = spark.read.schema(f"{md5_col} string, embedding array<float>").parquet(at)
    else:
        known = spark.createDataFrame([], f"{md5_col} string, embedding array<float>")
    missing = df.select(md5_col, text_col).dropDuplicates([md5_col]).join(known.select(md5_col), md5_col, "left_anti")
    fresh = write(embed(missing, text_col, model).select(md5_col, "embedding"), "embedded").df
    fresh.write.mode("append").parquet(at)
    every = known.unionByName(fresh).dropDuplicates([md5_col])
    return df.drop("embedding").join(every, md5_col).select(*[c for c in df.columns if c != "embedding"], F.col("embedding"))
