"""Vectorised word and shingle hashing for Arrow batches.

Words are the longest runs of letters or digits, in lower case.  A shingle is
the ordered hash of ``n`` consecutive words.  Everything is done on flat numpy
arrays over the code points of a whole batch: no loop over words, and none
over documents.  Hashes are 64-bit and depend on nothing but the text, so
they agree between workers, sessions and batches.
"""

from __future__ import annotations

import sys

import numpy as np

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Code points hashed at a time; bounds the memory of one call.
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser of a uint64 array."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Tables:
    """Per-process tables over all code points: letter or digit, and a 64-bit
    hash of each."""

    alnum: np.ndarray | None = None
    hashed: np.ndarray | None = None

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls.alnum is None:
            n = sys.maxunicode + 1
            cls.hashed = mix(np.arange(n, dtype=np.uint64))
            cls.alnum = np.fromiter((chr(c).isalnum() for c in range(n)), bool, n)
        return cls.alnum, cls.hashed


class _Powers:
    up = np.empty(0, np.uint64)
    down = np.empty(0, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, _BLOCK)
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up[:n], cls.down[:n]


class Words:
    """Hashes of a batch of texts: ``words`` (flat), ``counts`` (words per
    text), ``letters`` (one per text: its letters and digits in order)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, letters: np.ndarray):
        self.words, self.counts, self.letters = words, counts, letters

    def sequences(self) -> np.ndarray:
        """One hash per text: its words in order."""
        n = len(self.words)
        up, down = _Powers.get(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words * up[:n], out=total[1:])
        end = np.cumsum(self.counts)
        start = end - self.counts
        return mix((total[end] - total[start]) * down[start] + self.counts.astype(np.uint64))


def _block(texts: list[str]) -> Words:
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    alnum, hashed = _Tables.get()
    n = len(cp)
    ok = np.zeros(n + 2, bool)
    ok[1:-1] = alnum[cp]
    edge = np.flatnonzero(ok[1:] != ok[:-1])  # starts and ends, in turn
    start, end = edge[0::2], edge[1::2]
    kept = hashed[cp[ok[1:-1]]]
    m = len(kept)
    up, down = _Powers.get(m + 1)
    total = np.zeros(m + 1, np.uint64)
    np.cumsum(kept * up[:m], out=total[1:])
    size = end - start
    last = np.cumsum(size)  # ends of words among the letters kept
    first = last - size
    words = mix((total[last] - total[first]) * down[first] + size.astype(np.uint64))
    border = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    upto = np.searchsorted(start, border, "left")
    counts = np.diff(upto, prepend=0)
    ends = np.concatenate(([0], last))[upto]
    begins = np.concatenate(([0], ends[:-1]))
    letters = mix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    return Words(words, counts, letters)


def read(texts: list[str | None]) -> Words:
    """Hash a batch.  A null counts as the empty text; texts are not cut: a
    block may hold a single long one."""
    parts, block, size = [], [], 0
    for t in texts:
        t = (t or "").lower()
        block.append(t)
        size += len(t)
        if size >= _BLOCK:
            parts.append(_block(block))
            block, size = [], 0
    if block or not parts:
        parts.append(_block(block))
    return Words(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("words", "counts", "letters")))


def shingles(w: Words, n: int, distinct: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Flat hashes of each text's n-word shingles and their number per text (0
    where a text has fewer than n words).  ``distinct``: each once, sorted."""
    words, counts = w.words, w.counts
    docs = len(counts)
    if len(words) < n:
        return np.empty(0, np.uint64), np.zeros(docs, np.int64)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = mix(h * np.uint64(3)) + words[k : len(words) - n + 1 + k]
    h = mix(h)
    owner = np.repeat(np.arange(docs), counts)
    keep = owner[: len(h)] == owner[n - 1 :]
    h, owner = h[keep], owner[: len(h)][keep]
    if distinct:
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
    return h, np.bincount(owner, minlength=docs)


def signatures(h: np.ndarray, counts: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """MinHash signatures, one row of k uint32 per text; zero without shingles."""
    out = np.zeros((len(counts), k), np.uint32)
    has = np.flatnonzero(counts)
    if not len(has):
        return out
    starts = np.concatenate(([0], np.cumsum(counts[has])[:-1]))
    rng = np.random.RandomState(seed)
    with np.errstate(over="ignore"):  # numpy warns of scalars that wrap around
        for j in range(k):
            a = np.uint64(rng.randint(0, 1 << 31) * 4 + 1) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
            b = np.uint64(rng.randint(0, 1 << 31)) * np.uint64(0xD6E8FEB86659FD93)
            v = ((h * a + b) >> np.uint64(32)).astype(np.uint32)
            out[has, j] = np.minimum.reduceat(v, starts)
    return out


def blocks(sig: np.ndarray, width: int) -> np.ndarray:
    """Signature columns hashed in groups of ``width``: one uint64 per block;
    the block's position is part of its hash."""
    n, k = sig.shape
    with np.errstate(over="ignore"):
        cols = []
        for b in range(k // width):
            v = np.full(n, b + 1, np.uint64)
            for j in range(b * width, (b + 1) * width):
                v = mix(v * np.uint64(5) + sig[:, j].astype(np.uint64))
            cols.append(v)
    return np.stack(cols, 1) if cols else np.empty((n, 0), np.uint64)
