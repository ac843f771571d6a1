"""Duplicates hidden by formatting: progressive partition refinement.

Pass 1 groups all rows by cheap invariants (the stripped length and a letter
histogram, the same for any order of fields).  Pass 2 computes the costlier
key, a digest of the letters and digits in order or of the sorted field lines
of a card, only for rows whose class has several members.  Both passes are
expressions in generated code; only ids and keys are shuffled, never texts.  The
classes reach the second scan as a bitmap of a fixed size, however many they are.

Defined cases: null texts are in no group; texts without any letter or digit
have one form, the empty one; ties for the smallest id cannot matter (ids that
occur in several rows count once per row, a pair of equal ids is not returned);
empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.runtime import join_groups, maybe_in, python_space, write

#: Letters counted in the histogram.
HISTOGRAM = "eanritos"
_NOT_ALNUM = r"[^\p{L}\p{N}]+"
_LINES = r"\r\n|[\n\u000b\u000c\r\u001c-\u001e\u0085\u2028\u2029]"
_FIELD = f"^[{python_space()}]*[\\p{{L}}\\p{{N}}]+[{python_space()}]*:.*[\\p{{L}}\\p{{N}}]"
_FIRST = r"^[^\p{L}\p{N}]*[\p{L}\p{N}]+[^\p{L}\p{N}]*:"
_BLANK = f"^[{python_space()}]*$"


def letters_and_digits(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), _NOT_ALNUM, "")


def _invariants(stripped: Column) -> Column:
    size = F.length(stripped)
    counts = [size - F.length(F.replace(stripped, F.lit(c), F.lit(""))) for c in HISTOGRAM]
    return F.xxhash64(size, *counts)


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


def form_keys(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` plus ``in_order`` (digest of letters and digits) and
    ``as_card`` (digest of the sorted field lines, null unless every non-blank
    line is a single-word field, a colon and a value)."""
    lines = F.filter(F.split(F.lower(F.col(text)), _LINES), lambda x: ~x.rlike(_BLANK))
    first = F.col(text).rlike(_FIRST)  # spares most texts the split
    card = F.when(
        first & F.forall(lines, lambda x: x.rlike(_FIELD)),
        F.array_join(F.array_sort(F.transform(lines, lambda x: F.regexp_replace(x, _NOT_ALNUM, ""))), "\n"),
    )
    return df.select(
        *keep, _digest(letters_and_digits(F.col(text))).alias("in_order"), _digest(card).alias("as_card")
    )


def same_form_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form, n_copies, first_id) of every row whose form occurs again.

    ``first_id`` is the smallest id of the group and ``n_copies`` its rows.
    """
    base = df.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    cheap = base.select("id", "text", letters_and_digits(F.col("text")).alias("stripped")).select(
        "id", "text", _invariants(F.col("stripped")).alias("k1")
    )
    several = write(
        cheap.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1"), "form-classes"
    ).df
    # the second scan drops nearly all other rows before a text is digested; a
    # row that stays by chance is alone in its form, too
    keys = write(form_keys(maybe_in(cheap, several, "k1"), "text", ["id"]), "form-keys").df
    # a text that is no card has the form of a card with the same letters
    cards = (
        keys.where("as_card is not null").groupBy("in_order").agg(F.min("as_card").alias("card_form"))
    )
    plain = keys.where("as_card is null").groupBy("in_order").agg(F.count(F.lit(1)).alias("n"))
    shared = plain.join(cards, "in_order").select("in_order", "card_form")
    m = write(shared, "form-mixed").df
    if m.limit(1).count():
        mixed = F.when(F.col("as_card").isNull(), F.col("card_form"))
        keys = keys.join(m, "in_order", "left").select(
            "id", F.coalesce("as_card", mixed, "in_order").alias("form")
        )
    else:
        keys = keys.select("id", F.coalesce("as_card", "in_order").alias("form"))
    groups = (
        keys.groupBy("form")
        .agg(F.count(F.lit(1)).alias("n_copies"), F.min("id").alias("first_id"))
        .where("n_copies > 1")
    )
    groups = write(groups, "form-groups").df
    total = groups.agg(F.coalesce(F.sum("n_copies"), F.lit(0))).first()[0]
    return join_groups(keys, groups, "form", "n_copies", total)


def found_copies(df: DataFrame, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """(document_id, copy_document_id): one row per member of a group of the
    same form other than its smallest id."""
    return (
        same_form_groups(df, id_col, text_col)
        .where("id <> first_id")
        .select(F.col("first_id").alias("document_id"), F.col("id").alias("copy_document_id"))
    )


def collapsed(df: DataFrame, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """(document_id, n_copies): one row per form over all non-null texts."""
    groups = same_form_groups(df, id_col, text_col)
    copies = groups.where("id <> first_id").select("id")
    sizes = groups.where("id = first_id").select("id", "n_copies").distinct()
    ids = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"))
    return (
        ids.join(copies, "id", "left_anti")
        .join(sizes, "id", "left")
        .select(
            F.col("id").alias("document_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies")
        )
    )
