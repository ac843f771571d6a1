"""Near-duplicates: pigeonhole blocks over fingerprints.

A text's fingerprint is a MinHash signature of its distinct word shingles,
``BLOCKS * WIDTH`` components long; two texts of similarity s differ in about
(1 - s) of them.  The fingerprint is split into BLOCKS blocks: two that differ
in fewer than BLOCKS components must share a whole block (pigeonhole), and at
a similarity of 0.6 a pair shares none with a probability of 0.0018.  Texts
are joined on blocks, pairs whose Hamming distance is beyond what the threshold
allows for (``radius``) are dropped, and what remains is verified on the shingle
sets themselves.

Copies (same words, same letters) are one class with one set of blocks, so a
group of copies costs no pairs; classes expand to rows only at the very end.  A
block that more than HOT_BLOCK classes share is not joined as such: its classes
are joined on the shingles of theirs that are rarest within the block, of which
a pair above the threshold has one in common for certain.

Defined cases: null texts and texts of fewer than three words have no
shingles and are similar to nothing; repeated rows belong to one class; hashes
of 64 bits stand for words, shingles and forms; empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm import words as W
from vecspark.llm.components import components
from vecspark.runtime import join_salted, maybe_in, write

BLOCKS, WIDTH, SHINGLE = 26, 3, 3
#: Classes remembered by a task so that copies do not repeat their blocks.
_SEEN = 200_000
#: Classes of a block from which on it is split by a second key.
HOT_BLOCK = 500
_FIRST_FIELD = re.compile(r"[\W_]*[^\W_]+\s*:")
_FIELD = re.compile(r"\s*[^\W_]+\s*:.*[^\W_]")


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _cards(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(is a card, hash of the set of field lines) of each text."""
    which, lines, sizes = [], [], []
    for i, t in enumerate(texts):
        if t and _FIRST_FIELD.match(t):
            own = [x for x in t.lower().splitlines() if x.strip()]
            if all(map(_FIELD.match, own)):
                which.append(i)
                sizes.append(len(own))
                lines += own
    card, key = np.zeros(len(texts), bool), np.zeros(len(texts), np.uint64)
    if which:
        each = W.mix(W.read(lines).letters)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        card[which] = True
        key[which] = W.mix(np.add.reduceat(each, starts))
    return card, key


def profile(df: DataFrame, id_col: str, text_col: str, forms: bool = False) -> DataFrame:
    """(id, cls, in_order, as_card, keys): class of copies, form hashes and,
    once per class and task, its blocks (``forms``: and its forms) as join keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                texts = part.column(1).to_pylist()
                w = W.read(texts)
                card, lines = _cards(texts)
                cls = W.mix(w.sequences() * np.uint64(3) + w.letters * np.uint64(5) + lines)
                first = np.zeros(len(texts), bool)
                if len(seen) > _SEEN:
                    seen.clear()
                for i, c in enumerate(cls.tolist()):
                    if c not in seen:
                        seen.add(c)
                        first[i] = True
                new = W.Words(w.words[np.repeat(first, w.counts)], w.counts[first], w.letters[first])
                h, n = W.shingles(new, SHINGLE, distinct=False)
                keys = W.blocks(W.signatures(h, n, BLOCKS * WIDTH), WIDTH)
                valid = np.repeat((n > 0)[:, None], BLOCKS, 1)
                if forms:
                    tags = np.stack([W.mix(w.letters[first] + np.uint64(1)), W.mix(lines[first] + np.uint64(2))], 1)
                    keys = np.concatenate([keys, tags], 1)
                    valid = np.concatenate([valid, np.ones((len(n), 1), bool), card[first][:, None]], 1)
                sizes = np.zeros(len(texts), np.int64)
                sizes[first] = valid.sum(1)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        _signed(cls),
                        _signed(w.letters),
                        pa.array(lines.view(np.int64), mask=~card),
                        pa.ListArray.from_arrays(pa.array(offsets), _signed(keys[valid])),
                    ],
                    ["id", "cls", "in_order", "as_card", "keys"],
                )

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id string, cls long, in_order long, as_card long, keys array<long>"
    )


def key_rows(profiles: DataFrame) -> DataFrame:
    """Distinct (key, cls), partitioned by key."""
    return (
        profiles.where(F.size("keys") > 0)
        .select(F.explode("keys").alias("key"), "cls")
        .repartition("key")
        .dropDuplicates(["key", "cls"])
    )


#: What (profiles, table, id column, text column) of some classes are.
Source = tuple[DataFrame, DataFrame, str, str]


def block_pairs(keys: DataFrame, sources: list[Source], threshold: float) -> DataFrame:
    """Distinct (cls_a, cls_b), cls_a < cls_b, of classes that share a key.

    ``keys``: (key, cls, new); a pair needs a side that is ``new``.  Blocks of
    more than HOT_BLOCK classes leave as they are and are split by ``_split``.
    """
    sized = keys.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    cold = sized.where(F.col("n") <= HOT_BLOCK)
    pairs = _joined(cold, ["key"]).withColumn("key", F.lit(None).cast("long"))
    hot = sized.where(F.col("n") > HOT_BLOCK).select(F.col("cls").alias("cls_a"), F.when(F.col("new"), F.col("cls")).alias("cls_b"), "key")
    met = write(pairs.unionByName(hot), "near-blocks").df
    pairs = met.where("key is null").drop("key")
    blocks = met.where("key is not null").select("key", F.col("cls_a").alias("cls"), F.col("cls_b").isNotNull().alias("new"))
    if not blocks.limit(1).count():
        return pairs
    return pairs.unionByName(_split(blocks, sources, threshold)).distinct()


def _joined(rows: DataFrame, on: list[str]) -> DataFrame:
    a = rows.select(*on, F.col("cls").alias("cls_a"), F.col("new").alias("new_a"))
    b = rows.select(*on, F.col("cls").alias("cls_b"), F.col("new").alias("new_b"))
    return a.join(b, on).where("cls_a < cls_b and (new_a or new_b)").select("cls_a", "cls_b").distinct()


def _split(blocks: DataFrame, sources: list[Source], threshold: float) -> DataFrame:
    """Pairs within hot ``blocks`` (key, cls, new), with none above the
    threshold missing: of n shingles, two similar classes have one in common
    among the n - ceil(threshold * n) + 1 that come first in any order; here,
    the rarest within the block."""
    sets = _class_sets(blocks.select("cls").distinct(), sources).select("cls", "shingles", "size")
    terms = write(
        blocks.join(sets, "cls").select("key", "cls", "new", "size", F.explode("shingles").alias("g")), "near-terms"
    ).df
    counts = terms.groupBy("key", "g").agg(F.count(F.lit(1)).alias("uses"))
    rank = F.row_number().over(Window.partitionBy("key", "cls").orderBy("uses", "g"))
    first = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
    rare = terms.join(counts, ["key", "g"]).withColumn("rank", rank).where((F.col("rank") <= first) & (F.col("uses") > 1))
    return _joined(rare, ["key", "g"])


def _sets(texts: DataFrame) -> DataFrame:
    """(cls, sig, shingles, in_order, as_card) of (cls, text, in_order, as_card)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                h, n = W.shingles(W.read(part.column(1).to_pylist()), SHINGLE)
                sig = W.signatures(h, n, BLOCKS * WIDTH)
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(len(n) + 1, dtype=np.int32) * (BLOCKS * WIDTH)),
                            pa.array(sig.reshape(-1).astype(np.uint16).view(np.int16)),
                        ),
                        pa.ListArray.from_arrays(pa.array(ends), _signed(h)),
                        part.column(2),
                        part.column(3),
                    ],
                    ["cls", "sig", "shingles", "in_order", "as_card"],
                )

    return texts.mapInArrow(run, "cls long, sig array<short>, shingles array<long>, in_order long, as_card long")


def same_form(a: str, b: str) -> Column:
    """Whether two sides, by their form hashes, have the same form."""
    return F.when(
        F.col(f"{a}as_card").isNotNull() & F.col(f"{b}as_card").isNotNull(),
        F.col(f"{a}as_card") == F.col(f"{b}as_card"),
    ).otherwise(F.col(f"{a}in_order") == F.col(f"{b}in_order"))


def radius(threshold: float) -> int:
    """Hamming distance up to which fingerprints may belong to a pair of at
    least ``threshold``: the mean plus four standard deviations."""
    k = BLOCKS * WIDTH
    return int(k * (1 - threshold) + 4 * (k * threshold * (1 - threshold)) ** 0.5) + 1


def class_sets(pairs: DataFrame, sources: list[Source]) -> DataFrame:
    """(cls, sig, shingles, in_order, as_card, size) of the classes in ``pairs``."""
    return _class_sets(
        pairs.select(F.col("cls_a").alias("cls")).unionByName(pairs.select(F.col("cls_b").alias("cls"))).distinct(), sources
    )


def _class_sets(classes: DataFrame, sources: list[Source]) -> DataFrame:
    """Only one text per class is read again; a bitmap of their ids keeps most
    others out of the shuffle."""
    wanted = write(classes, "near-classes").df
    sets = None
    for profiles, table, id_col, text_col in sources:
        reps = write(
            maybe_in(profiles.select("id", "cls", "in_order", "as_card"), wanted, "cls").join(wanted, "cls")
            .groupBy("cls", "in_order", "as_card").agg(F.min("id").alias("id")),
            "near-texts",
        ).df
        texts = maybe_in(table.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), reps, "id").join(reps, "id")
        own = _sets(texts.select("cls", "text", "in_order", "as_card"))
        sets = own if sets is None else sets.unionByName(own)
    # a class may be in several sources, a row several times in one
    sets = sets.dropDuplicates(["cls"])
    return write(sets.withColumn("size", F.size("shingles")), "near-sets").df


def _similarity(rows: DataFrame) -> DataFrame:
    """``rows`` with the similarity of ``a_shingles`` and ``b_shingles``."""
    both = F.size(F.array_intersect("a_shingles", "b_shingles"))
    either = F.size("a_shingles") + F.size("b_shingles") - F.col("both")
    return rows.withColumn("both", both).withColumn(
        "similarity", F.when(either > 0, F.col("both") / either).otherwise(F.lit(0.0))
    )


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(cls_a, cls_b, similarity) of all of a bounded number of ``pairs``."""
    for x in ("a", "b"):
        own = sets.select(F.col("cls").alias(f"cls_{x}"), F.col("shingles").alias(f"{x}_shingles"))
        pairs = pairs.join(own, f"cls_{x}")
    return _similarity(pairs).select("cls_a", "cls_b", "similarity")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float, form_too: bool) -> DataFrame:
    """(cls_a, cls_b, similarity, same_form) of the candidate pairs that hold.

    ``sets``: of their classes, see ``class_sets``.  ``form_too`` also keeps
    pairs of the same form below the threshold.
    """
    for x in ("a", "b"):
        own = sets.select(F.col("cls").alias(f"cls_{x}"), *(F.col(c).alias(f"{x}_{c}") for c in ("sig", "shingles", "size", "in_order", "as_card")))
        pairs = pairs.join(own, f"cls_{x}")
    # the fingerprints decide which pairs' shingle sets are compared
    distance = F.size(F.filter(F.zip_with("a_sig", "b_sig", lambda x, y: x != y), lambda x: x))
    some = (F.col("a_size") > 0) & (F.col("b_size") > 0)
    met = pairs.withColumn("same_form", same_form("a_", "b_"))
    near = F.coalesce(some & (distance <= radius(threshold)), F.lit(False))
    met = _similarity(met.where(near | F.col("same_form") if form_too else near & ~F.col("same_form")))
    enough = F.col("similarity") >= threshold - 1e-12
    return met.where(enough | F.col("same_form") if form_too else enough).select(
        "cls_a", "cls_b", "similarity", "same_form"
    )


def class_links(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, cls) of every row with a text, and the verified
    links (cls_a, cls_b, similarity) between classes of different form."""
    table = df.where(F.col(text_col).isNotNull())
    profiles = write(profile(table, id_col, text_col), "near-profiles").df
    sources = [(profiles, table, id_col, text_col)]
    pairs = write(block_pairs(key_rows(profiles).withColumn("new", F.lit(True)), sources, threshold), "near-pairs").df
    sets = class_sets(pairs, sources)
    links = write(verified(pairs, sets, threshold, False), "near-links").df
    return profiles.select("id", "cls"), links


def found_pairs(df: DataFrame, id_col: str = "document_id", text_col: str = "content",
                threshold: float = 0.6) -> DataFrame:
    """(document_id_a, document_id_b): similar rows of different form."""
    members, links = class_links(df, id_col, text_col, threshold)
    members = members.distinct()
    total = members.count()
    a = members.select(F.col("id").alias("x"), F.col("cls").alias("cls_a"))
    b = members.select(F.col("id").alias("y"), F.col("cls").alias("cls_b"))
    met = join_salted(links.select("cls_a", "cls_b"), a, "cls_a", "x", total)
    return (
        join_salted(met, b, "cls_b", "y", total).where("x <> y")
        .select(F.least("x", "y").alias("document_id_a"), F.greatest("x", "y").alias("document_id_b"))
    )


def near_groups(df: DataFrame, id_col: str = "document_id", text_col: str = "content",
                threshold: float = 0.8) -> DataFrame:
    """(id, group_id, n_links): one row per row in a group of near-duplicates
    of different form; ``n_links`` counts links between classes, not copies."""
    members, links = class_links(df, id_col, text_col, threshold)
    groups = write(components(links, "cls_a", "cls_b"), "near-groups").df
    degree = (
        links.select(F.col("cls_a").alias("cls")).unionByName(links.select(F.col("cls_b").alias("cls")))
        .groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    )
    rows = members.join(
        groups.join(degree, F.col("node") == F.col("cls")).select("cls", "component", "n_links"), "cls"
    )
    names = rows.groupBy("component").agg(F.min("id").alias("group_id"))
    return rows.join(names, "component").select("id", "group_id", "n_links")
