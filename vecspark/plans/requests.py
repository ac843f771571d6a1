"""Search requests as a table: which way each query becomes a vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.functions import text, vectors


def hint(encoding: Column) -> Column:
    """plaintext, base64, vector or null of a dirty spelling."""
    c = F.lower(text.strip(encoding))
    return F.when(c.isin("plaintext", "base64", "vector"), c)


def dispatch(requests: DataFrame, dim: int = 64) -> DataFrame:
    """``requests`` with ``route``: vector (given), base64, embed or invalid,
    and ``vector`` where no model is needed.

    A vector is taken as it is, whatever the hint.  A text with the hint vector
    is invalid, and so is an empty request.  Without a hint, a text counts as
    base64 only if it decodes to a vector of ``dim`` elements.
    """
    h = hint(F.col("encoding"))
    given = F.col("query_vector").isNotNull() & (F.size("query_vector") > 0)
    empty = F.coalesce(F.col("query"), F.lit("")) == ""
    size = F.length(F.try_to_binary(F.col("query"), F.lit("base64")))
    like = text.is_base64(F.col("query")) & (F.length("query") > 12) & (size == 4 * dim)
    route = (
        F.when(given, "vector").when(empty, "invalid").when(h == "vector", "invalid")
        .when(h == "base64", F.when(text.is_base64(F.col("query")) & (size == 4 * dim), "base64").otherwise("invalid"))
        .when(h.isNull() & F.coalesce(like, F.lit(False)), "base64").otherwise("embed")
    )
    routed = requests.withColumn("route", route)
    decoded = vectors.base64_to_vector(F.when(F.col("route") == "base64", F.col("query")))
    return routed.withColumn(
        "vector", F.when(F.col("route") == "vector", F.col("query_vector")).when(F.col("route") == "base64", decoded)
    )
