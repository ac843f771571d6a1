"""Text expressions, all built-in functions inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecspark.runtime import python_space, strip

__all__ = ["content_md5", "default_name", "first_line_name", "is_base64", "is_blank", "json_object", "lines_chunks",
           "python_space", "str_or_none", "strip"]


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def str_or_none(c: Column) -> Column:
    """The stripped text, or null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def content_md5(c: Column) -> Column:
    """md5 of the UTF-8 of the stripped text."""
    return F.md5(strip(c).cast("binary"))


def default_name(c: Column, size: int = 36) -> Column:
    """The start of the first paragraph."""
    return F.substring(F.split_part(strip(c), F.lit("\n\n"), F.lit(1)), 1, size)


def first_line_name(c: Column, size: int = 28) -> Column:
    """The start of the first line, as it is."""
    return F.substring(F.split_part(c, F.lit("\n"), F.lit(1)), 1, size)


def is_base64(c: Column) -> Column:
    """Whether a text is well-formed base64 of whole four-letter groups."""
    shape = (F.length(c) % 4 == 0) & c.rlike(r"\A[A-Za-z0-9+/]+={0,2}\z")
    return F.coalesce(shape & F.try_to_binary(c, F.lit("base64")).isNotNull(), F.lit(False))


def json_object(c: Column) -> Column:
    """A JSON object's text; ``{}`` for null, blank and broken JSON."""
    parsed = F.try_parse_json(c)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed)).otherwise(F.lit("{}"))


def lines_chunks(c: Column, lines: int = 20) -> Column:
    """Array of chunks of at most ``lines`` lines."""
    parts = F.split(c, "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / lines).cast("int"))
    return F.transform(starts, lambda k: F.array_join(F.slice(parts, k * lines + 1, lines), "\n"))
