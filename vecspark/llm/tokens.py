"""Byte-level BPE of a public tokenizer: exact ids of whole corpora.

Long texts are cut into segments that are encoded in parallel and put together
again as a tree.  A cut before white space that follows another character is
always a border between pieces, so ids are just concatenated there.  Text
without such borders is cut inside a run of one character class; at such a
join, growing windows of tokens around it are encoded anew until the window's
outer tokens on both sides equal those that were there, which for BPE makes
the whole sequence the exact encoding (a sequence is valid if every adjacent
pair is).

Defined cases: null and empty texts get an empty list; special tokens' strings
are ordinary text; repeated rows are encoded each; further columns pass by.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters above which a text is cut into segments of about this size.
SEGMENT = 8192
_BACK = 2048
#: Characters handed to the tokenizer at a time.
_CHUNK = 1 << 18
#: Pre-tokenisation pattern of the vocabulary (a fixed value of the tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Bpe:
    """The vocabulary of a rank file."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(
            "vocabulary", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={}
        )
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pattern = regex.compile(PATTERN)

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece, without splitting it first."""
        return self.encoding._core_bpe.encode_single_piece(data)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(t) for t in texts]


@functools.lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """One vocabulary per worker process."""
    return Bpe(path)


def _kind(c: str) -> str:
    if c.isalpha():
        return "L"
    if c.isnumeric():
        return "N"
    return "S" if c.isspace() else "P"


def cuts(text: str, size: int = SEGMENT) -> list[tuple[int, bool]]:
    """Cut positions of a long text and whether each is a border of pieces."""
    out, at, n = [], 0, len(text)
    while n - at > size + size // 2:
        want = at + size
        found = None
        for i in range(want, max(at + size // 2, want - _BACK), -1):
            if text[i].isspace() and not text[i - 1].isspace():
                found = (i, True)
                break
        if found is None:
            for i in range(want, at + size // 2, -1):
                kinds = {_kind(c) for c in text[i - 4 : i + 4]}
                if len(kinds) == 1 and "'" not in text[i - 4 : i + 4]:
                    found = (i, False)
                    break
                if text[i].isspace() and not text[i - 1].isspace():
                    found = (i, True)
                    break
        if found is None:  # no such place in half a segment: look further on
            for i in range(want, n - 4):
                kinds = {_kind(c) for c in text[i - 4 : i + 4]}
                border = text[i].isspace() and not text[i - 1].isspace()
                if border or (len(kinds) == 1 and "'" not in text[i - 4 : i + 4]):
                    found = (i, border)
                    break
        if found is None:
            break
        out.append(found)
        at = found[0]
    return out


class Part:
    """Ids of a stretch of text, and how many of them belong to its first and
    last piece (which a join may change)."""

    __slots__ = ("ids", "head", "tail")

    def __init__(self, ids: list[int], head: int, tail: int):
        self.ids, self.head, self.tail = ids, head, tail


def part(v: Bpe, text: str) -> Part:
    ids = v.encoding.encode_ordinary(text)
    pieces = v.pattern.finditer(text)
    first = next(pieces, None)
    if first is None:
        return Part(ids, 0, 0)
    last = first
    for last in pieces:
        pass
    return Part(ids, len(v.piece(first.group().encode())), len(v.piece(last.group().encode())))


def join(v: Bpe, a: Part, b: Part, border: bool) -> Part:
    """The encoding of two adjacent stretches of text from their encodings."""
    if border or not a.ids or not b.ids:
        if not a.ids:
            return b
        if not b.ids:
            return a
        return Part(a.ids + b.ids, a.head, b.tail)
    w = 4
    while True:
        left, right = a.ids[-min(w, a.tail) :], b.ids[: min(w, b.head)]
        new = v.piece(b"".join(v.bytes_of[i] for i in left + right))
        if (len(left) == a.tail or new[0] == left[0]) and (len(right) == b.head or new[-1] == right[-1]):
            break
        w *= 2
    ids = a.ids[: len(a.ids) - len(left)] + new + b.ids[len(right) :]
    grown = a.tail - len(left) + len(new) + b.head - len(right)
    head = grown if a.tail == len(a.ids) else a.head
    tail = grown if b.head == len(b.ids) else b.tail
    return Part(ids, head, tail)


def concatenate(v: Bpe, parts: list[Part], borders: list[bool]) -> Part:
    """Join neighbours pairwise, level by level."""
    borders = list(borders)
    while len(parts) > 1:
        up, ub = [], []
        for i in range(0, len(parts) - 1, 2):
            up.append(join(v, parts[i], parts[i + 1], borders[i]))
            if i + 1 < len(borders):
                ub.append(borders[i + 1])
        if len(parts) % 2:
            up.append(parts[-1])
        parts, borders = up, ub[: len(up) - 1]
    return parts[0] if parts else Part([], 0, 0)


def encode_tree(v: Bpe, text: str, size: int = SEGMENT) -> list[int]:
    """Encode one text by way of segments (all in this process)."""
    at = cuts(text, size)
    ends = [0, *(i for i, _ in at), len(text)]
    return concatenate(v, [part(v, text[a:b]) for a, b in zip(ends, ends[1:])], [b for _, b in at]).ids


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about _CHUNK characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _CHUNK:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _list_array(lists: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None,
           segment: int = SEGMENT) -> DataFrame:
    """(id, ids): the ids of every row's text."""
    path = vocabulary or default_vocabulary()
    base = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    long = F.length("text") > segment + segment // 2

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _slices(texts):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), _list_array(v.encode(texts[i:j]))], ["id", "ids"]
                )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, text in enumerate(b.column(1).to_pylist()):
                at = cuts(text, segment)
                ends = [0, *(i for i, _ in at), len(text)]
                n = len(ends) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([b.column(2).slice(r, 1)] * n),
                        pa.concat_arrays([b.column(0).slice(r, 1)] * n),
                        pa.array(range(n), pa.int32()),
                        pa.array([True, *(x for _, x in at)]),
                        pa.array([text[p:q] for p, q in zip(ends, ends[1:])]),
                    ],
                    ["row", "id", "no", "border", "text"],
                )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe(path)
        for b in batches:
            got = [part(v, t) for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(4)), _list_array([p.ids for p in got]),
                 pa.array([p.head for p in got], pa.int32()), pa.array([p.tail for p in got], pa.int32())],
                ["row", "id", "no", "border", "ids", "head", "tail"],
            )

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe(path)
        for b in batches:
            out, rows = [], []
            for r, x in enumerate(b.column(1).to_pylist()):
                copies = sum(s["no"] == 0 for s in x)  # equal rows share their key
                x = [s for _, s in sorted({s["no"]: s for s in x}.items())]
                parts = [Part(s["ids"], s["head"], s["tail"]) for s in x]
                ids = concatenate(v, parts, [s["border"] for s in x[1:]]).ids
                out += [ids] * copies
                rows += [r] * copies
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int32())), _list_array(out)], ["id", "ids"]
            )

    schema = f"id {id_type}, ids array<int>"
    small = base.where(~long).mapInArrow(short, schema)
    # ids may repeat, so a long text goes by a hash of id and text; a repeated
    # task gives the same, which a running number would not
    numbered = (
        base.where(long)
        .withColumn("row", F.xxhash64("id", "text"))
        .mapInArrow(split, f"row long, id {id_type}, no int, border boolean, text string")
    )
    large = (
        numbered.repartition(F.col("row"), F.col("no"))
        .mapInArrow(segments, f"row long, id {id_type}, no int, border boolean, ids array<int>, head int, tail int")
        .groupBy("row", "id")
        .agg(F.collect_list(F.struct("no", "border", "ids", "head", "tail")).alias("parts"))
        .select("id", "parts")
        .mapInArrow(together, schema)
    )
    return small.unionByName(large)
