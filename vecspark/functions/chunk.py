"""Splitting texts into chunks by lines and tokens.

A chunk ends, at a line's border, when either limit would be passed; a single
line of more tokens than a chunk may hold is split by tokens.  Joining the
chunks of one text by line breaks (or by nothing within a split line) gives the
text back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions import text
from vecspark.functions.ids import id_column

_PIECE = re.compile(r"\s*(?:\w+|[^\w\s])|\s+")


def count_words(s: str) -> int:
    """A tokenizer-free count: words and single marks."""
    return len(_PIECE.findall(s))


def tiktoken_counter(model: str = "gpt-4o") -> Callable[[str], int]:
    """The count of a public tokenizer, if its vocabulary is at hand; else the
    tokenizer-free one."""
    try:
        import tiktoken

        enc = tiktoken.encoding_for_model(model)
    except Exception:  # no package, or no network for its vocabulary
        return count_words
    return lambda s: len(enc.encode(s, disallowed_special=()))


def _split_line(line: str, limit: int, count: Callable[[str], int]) -> list[str]:
    out, part, n = [], "", 0
    for piece in _PIECE.findall(line):
        k = count(piece)
        if part and n + k > limit:
            out.append(part)
            part, n = "", 0
        part += piece
        n += k
    return [*out, part] if part or not out else out


def split_text(s: str, lines: int = 20, tokens: int = 500, count: Callable[[str], int] = count_words) -> list[str]:
    """The chunks of a text, in order."""
    if lines < 1 or tokens < 1:
        raise ValueError("limits must be positive")
    out: list[str] = []
    part: list[str] = []
    n = 0
    for line in s.split("\n"):
        k = count(line)
        if part and (len(part) == lines or n + k > tokens):
            out.append("\n".join(part))
            part, n = [], 0
        if k > tokens:
            out += _split_line(line, tokens, count)
            continue
        part.append(line)
        n += k
    if part:
        out.append("\n".join(part))
    return out


def chunk_documents(docs: DataFrame, *, lines: int = 20, tokens: int = 500,
                    count: Callable[[str], int] = count_words, link_parent: bool = False) -> DataFrame:
    """One row per non-blank chunk with a new id; write the result before using
    the ids twice.  ``link_parent`` puts the whole text's id into source_id."""

    @F.pandas_udf("array<struct<content:string,total_tokens:int>>")
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [
                {"content": c, "total_tokens": count(c)} for c in split_text(t, lines, tokens, count) if c.strip()
            ])

    tasks = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < tasks:  # few files: their texts are spread over all cores
        docs = docs.repartition(tasks)
    cut = docs.where(~text.is_blank(F.col("content"))).withColumn("_chunks", chunks("content"))
    cut = cut.select("*", F.size("_chunks").alias("_n"), F.posexplode("_chunks").alias("_at", "_chunk"))
    source = F.col("document_id") if link_parent else F.col("source_id")
    return cut.select(
        id_column("document").alias("document_id"), "name", F.col("_chunk.content").alias("content"),
        text.content_md5(F.col("_chunk.content")).alias("content_md5"), source.alias("source_id"),
        F.col("_at").alias("chunk_index"), (F.col("_n") != 1).alias("is_chunk"),
        F.col("_chunk.total_tokens").alias("total_tokens"), "metadata", "created_at", "updated_at",
    )
