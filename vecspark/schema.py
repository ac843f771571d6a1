"""Table schemas, and schemas made from JSON schemas."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import types as T

DOCUMENTS, POINTS, MANIFEST = "documents", "points", "manifest"


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
DOCUMENT_SCHEMA = _struct(
    ("document_id", _S, False), ("name", _S, False), ("content", _S, False), ("content_md5", _S, False),
    ("source_id", _S, True), ("chunk_index", _I, True), ("is_chunk", _B, True), ("total_tokens", _I, True),
    ("metadata", _S, True), ("created_at", _L, True), ("updated_at", _L, True),
)
POINT_SCHEMA = _struct(
    ("point_id", _S, False), ("document_id", _S, False), ("content_md5", _S, False),
    ("embedding", T.ArrayType(T.FloatType()), True), ("metadata", _S, True),
)
MANIFEST_SCHEMA = _struct(
    ("name", _S, True), ("description", _S, True), ("version", _S, True), ("manifest_table_name", _S, True),
    ("points_table_name", _S, True), ("documents_table_name", _S, True), ("embedding_model", _S, False),
    ("embedding_dimensions", _I, False),
)
SCHEMAS = {DOCUMENTS: DOCUMENT_SCHEMA, POINTS: POINT_SCHEMA, MANIFEST: MANIFEST_SCHEMA}
KEYS = {DOCUMENTS: "document_id", POINTS: "point_id", MANIFEST: "name"}

_SIMPLE = {
    "string": T.StringType(), "text": T.StringType(), "integer": T.LongType(), "boolean": T.BooleanType(),
    "number": T.FloatType(), "object": T.StringType(),
}


def _type(prop: Mapping[str, Any]) -> T.DataType:
    kind = prop.get("type")
    if kind == "array":
        number = (prop.get("items") or {}).get("type") == "number"
        return T.ArrayType(T.FloatType() if number else T.StringType())
    if kind == "string" and prop.get("maxLength"):
        return T.VarcharType(int(prop["maxLength"]))
    return _SIMPLE.get(kind, T.StringType())  # unions and unknown kinds are text


def struct_from_json_schema(
    schema: Mapping[str, Any], *, custom_types: Mapping[str, T.DataType] | None = None
) -> T.StructType:
    """A StructType in the order of ``properties``; ``required`` fields are not
    nullable, ``custom_types`` take precedence."""
    required, custom = set(schema.get("required", ())), dict(custom_types or {})
    return T.StructType(
        [T.StructField(n, custom.get(n) or _type(p), n not in required) for n, p in schema["properties"].items()]
    )


def ddl_from_json_schema(
    schema: Mapping[str, Any],
    *,
    table_name: str,
    primary_key: str | None = None,
    unique_fields: Sequence[str] = (),
    custom_types: Mapping[str, T.DataType] | None = None,
) -> str:
    """A Spark CREATE TABLE statement.  Spark has no unique constraints or
    secondary indexes: keys are recorded as table properties and enforced when
    rows are written."""
    if not re.fullmatch(r"\w+", table_name):
        raise ValueError(f"not a table name: {table_name!r}")
    fields = struct_from_json_schema(schema, custom_types=custom_types)
    for name in (*([primary_key] if primary_key else []), *unique_fields):
        fields[name]  # raises KeyError if missing
    columns = ",\n  ".join(
        f"`{f.name}` {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in fields
    )
    keys = {"primary_key": primary_key or "", "unique_fields": ",".join(unique_fields)}
    props = ", ".join(f"'{k}' = '{v}'" for k, v in keys.items() if v)
    return f"CREATE TABLE `{table_name}` (\n  {columns}\n) USING parquet" + (f" TBLPROPERTIES ({props})" if props else "")
