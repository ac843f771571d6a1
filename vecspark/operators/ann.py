"""Optional approximate search by random projections of unit vectors.

``search`` is exact and needs no index; this is for many lookups in a large
table that bear a loss.  On unit vectors, Euclidean distance d and cosine c
order alike: c = 1 - d * d / 2.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions import vectors


class CosineIndex:
    """Hash tables over the usable vectors of a table of points.

    Null vectors, vectors of another length or a zero norm are left out.
    """

    def __init__(self, points: DataFrame, dim: int, *, vector_col: str = "embedding", tables: int = 8,
                 bucket_length: float = 0.5, seed: int = 3):
        v = F.col(vector_col)
        usable = points.where(v.isNotNull() & (F.size(v) == dim)).withColumn("_norm", vectors.norm(v)).where(
            (F.col("_norm") > 0) & ~F.isnan("_norm")
        )
        rows = usable.withColumn("_unit", array_to_vector(F.transform(v, lambda x: x.cast("double") / F.col("_norm"))))
        lsh = BucketedRandomProjectionLSH(
            inputCol="_unit", outputCol="_hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed
        )
        self.dim = dim
        self.model = lsh.fit(rows)
        self.rows = self.model.transform(rows.drop("_norm"))

    def search(self, vector: list[float], k: int) -> DataFrame:
        """About the k best rows with ``relevance_score``, best first."""
        if k < 0:
            raise ValueError("top_k must not be negative")
        q = np.asarray(vector, np.float64)
        if len(q) != self.dim or not np.linalg.norm(q) > 0:
            raise ValueError(f"a query vector of {self.dim} dimensions and a positive norm is needed")
        if k == 0:
            return self.rows.limit(0).drop("_unit", "_hashes").withColumn("relevance_score", F.lit(0.0))
        found = self.model.approxNearestNeighbors(self.rows, Vectors.dense(q / np.linalg.norm(q)), k, "_d")
        score = 1 - F.col("_d") * F.col("_d") / 2
        return found.withColumn("relevance_score", score).drop("_unit", "_hashes", "_d").orderBy(F.desc("relevance_score"))
