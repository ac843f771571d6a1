import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark import schema
from vecspark.functions import chunk, ids, text, vectors
from vecspark.models import content_md5

SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c"))).first()[0]


def test_strip_and_hash_follow_python(spark):
    texts = [c + "x" + c for c in SPACES] + ["", "  ", "a b", "\x1cé　", None]
    rows = spark.createDataFrame([(t,) for t in texts], "c string").select("c", text.strip(F.col("c")), text.content_md5(F.col("c"))).collect()
    for t, s, h in rows:
        assert s == (t.strip() if t is not None else None)
        assert h == (content_md5(t) if t is not None else None)


def test_names(spark):
    assert one(spark, "\n  First paragraph\nline\n\nsecond", text.default_name) == "First paragraph\nline"
    assert one(spark, "x" * 50, text.default_name) == "x" * 36
    assert one(spark, "y" * 50 + "\nz", text.first_line_name) == "y" * 28
    assert one(spark, " a ", text.str_or_none) == "a" and one(spark, "　", text.str_or_none) is None


@pytest.mark.parametrize("value, want", [
    ("internationalize", True), ("abcd", True), ("abc", False), ("ab==", True), ("a===", False), ("", False), (None, False), ("ab d", False),
])
def test_is_base64(spark, value, want):
    assert one(spark, value, text.is_base64) is want


@pytest.mark.parametrize("value, want", [('{"a": 1}', '{"a":1}'), (None, "{}"), ("", "{}"), ("{broken", "{}"), ("[1]", "{}")])
def test_json_object(spark, value, want):
    assert one(spark, value, text.json_object) == want


def cos(spark, a, b):
    return spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(vectors.cosine(F.col("a"), F.col("b"))).first()[0]


def test_cosine(spark):
    assert math.isclose(cos(spark, [1.0, 2.0], [2.0, 4.0]), 1.0)
    assert math.isclose(cos(spark, [1.0, 0.0], [-1.0, 0.0]), -1.0)
    assert math.isnan(cos(spark, [0.0, 0.0], [1.0, 0.0]))
    assert cos(spark, None, [1.0]) is None and cos(spark, [1.0, None], [1.0, 1.0]) is None
    with pytest.raises(PySparkException):
        cos(spark, [1.0], [1.0, 2.0])


def test_checked_length(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert df.select(vectors.checked(F.col("v"), 2)).first()[0] == [1.0, 2.0]
    with pytest.raises(PySparkException):
        df.select(vectors.checked(F.col("v"), 3)).collect()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(width=32, allow_nan=False), max_size=20))
def test_base64_round_trip(v):
    assert vectors.decode_base64(vectors.encode_base64(v)) == v


def test_base64_columns(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,), ([],)], "v array<float>")
    got = df.select("v", vectors.base64_to_vector(vectors.vector_to_base64(F.col("v"))).alias("w")).collect()
    assert all(r["v"] == r["w"] for r in got)
    assert one(spark, "abcde", vectors.base64_to_vector) is None


def test_ids(spark):
    for kind, prefix in ids.PREFIXES.items():
        shape = re.compile(prefix + r"[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}")
        assert shape.fullmatch(ids.new_id(kind))
        got = [r[0] for r in spark.range(200).select(ids.id_column(kind)).collect()]
        assert all(map(shape.fullmatch, got)) and len(set(got)) == 200
    with pytest.raises(ValueError):
        ids.new_id("other")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n.", max_size=300), st.integers(1, 5), st.integers(1, 9))
def test_chunks(s, lines, tokens):
    got = chunk.split_text(s, lines, tokens)
    assert re.sub(r"\s", "", "".join(got)) == re.sub(r"\s", "", s)
    for c in got:
        assert c.count("\n") < lines and chunk.count_words(c) <= max(tokens, 1) + c.count("\n")


def test_one_line_is_one_chunk():
    assert chunk.split_text("just a line") == ["just a line"]
    assert len(chunk.split_text("\n".join("x" * 1 for _ in range(41)))) == 3


def test_chunk_documents(spark):
    docs = spark.createDataFrame(
        [("d1", "n", "a\nb\nc", "", "s", "{}", 1, 1), ("d2", "n", " ", "", "s", "{}", 1, 1), ("d3", "n", "one", "", "s", "{}", 1, 1)],
        "document_id string, name string, content string, content_md5 string, source_id string, metadata string, created_at long, updated_at long",
    )
    got = sorted(chunk.chunk_documents(docs, lines=2).collect(), key=lambda r: r["content"])
    assert [(r["content"], r["chunk_index"], r["is_chunk"], r["source_id"]) for r in got] == [
        ("a\nb", 0, True, "s"), ("c", 1, True, "s"), ("one", 0, False, "s")]
    assert {r["source_id"] for r in chunk.chunk_documents(docs, link_parent=True).collect()} == {"d1", "d3"}


def test_schema_from_json_schema():
    js = {
        "properties": {
            "id": {"type": "string"}, "short": {"type": "string", "maxLength": 5}, "v": {"type": "array", "items": {"type": "number"}, "maxItems": 3},
            "tags": {"type": "array", "items": {"type": "string"}}, "n": {"type": "integer"}, "ok": {"type": "boolean"},
            "x": {"type": "number"}, "meta": {"type": "object"}, "any": {"anyOf": []}, "odd": {"type": "weird"}, "own": {"type": "string"},
        },
        "required": ["id"],
    }
    s = schema.struct_from_json_schema(js, custom_types={"own": T.DateType()})
    assert [f.dataType.simpleString() for f in s] == [
        "string", "varchar(5)", "array<float>", "array<string>", "bigint", "boolean", "float", "string", "string", "string", "date"]
    assert not s["id"].nullable and s["n"].nullable
    ddl = schema.ddl_from_json_schema(js, table_name="t", primary_key="id")
    assert "`id` STRING NOT NULL" in ddl and "'primary_key' = 'id'" in ddl
    with pytest.raises(KeyError):
        schema.ddl_from_json_schema(js, table_name="t", primary_key="nope")
    with pytest.raises(ValueError):
        schema.ddl_from_json_schema(js, table_name="t; drop")


def test_literal_is_narrowed(spark):
    assert spark.range(1).select(vectors.literal([0.1])).first()[0] == [float(np.float32(0.1))]
