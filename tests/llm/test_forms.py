import pytest
from pyspark.sql import functions as F

from vecspark import runtime
from vecspark.llm import forms

SCHEMA = "document_id string, content string, id int, form string, k1 int"
ROWS = [
    ("a", "Hello, World 1"), ("b", "hello world1!"), ("c", "hello world 2"), ("d", None), ("e", ""), ("f", " -- "),
    ("g", "Name: Ann\nCity: Rome"), ("h", "city:  ROME \r\n\r\n name: ann."), ("i", "City Rome name Ann"),
    ("j", "name ann city rome"), ("k", "Hello World 1"), ("k", "Hello World 1"),
    ("l", "x" * 200_000), ("m", "X " * 200_000),
]


def frame(spark, rows):
    return spark.createDataFrame([(a, t, 1, "f", 2) for a, t in rows], SCHEMA)


def test_groups(spark):
    got = {tuple(r) for r in forms.found_copies(frame(spark, ROWS)).collect()}
    assert {("a", "b"), ("a", "k"), ("e", "f"), ("g", "h"), ("l", "m")} <= got
    assert ("g", "j") in got  # the letters of the card in order
    assert ("g", "i") in got  # and of the other order
    assert not any("c" in p or "d" in p for p in got)


def test_collapsed_counts_every_row(spark):
    rows = [(f"r{i}", t) for i, (_, t) in enumerate(ROWS)]
    got = {r["document_id"]: r["n_copies"] for r in forms.collapsed(frame(spark, rows)).collect()}
    assert sum(got.values()) == sum(t is not None for _, t in rows)
    assert got["r0"] == 4 and got["r2"] == 1


@pytest.mark.parametrize("words", [2, 1 << 20])
def test_any_number_of_classes_fits_the_bitmap(spark, monkeypatch, words):
    monkeypatch.setattr(runtime, "BITMAP_WORDS", words)
    rows = [(f"h{i:04d}", "the hot form" if i % 3 else f"own {i}") for i in range(900)]
    got = forms.found_copies(frame(spark, rows)).collect()
    assert len(got) == 599 and {r[0] for r in got} == {"h0001"}


def test_texts_alone_in_their_class_are_not_digested(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    digest = forms.form_keys

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return t

    monkeypatch.setattr(forms, "form_keys", lambda df, text, keep: digest(df.withColumn(text, counted(text)), text, keep))
    rows = [(f"h{i:04d}", "hot form" if i % 9 == 0 else "abcdefgh"[i % 8] * (i + 1)) for i in range(900)]
    assert forms.found_copies(frame(spark, rows)).count() == 99
    assert seen.value < 300


def test_empty(spark):
    assert forms.found_copies(frame(spark, [])).count() == 0
    assert forms.collapsed(frame(spark, [])).count() == 0
