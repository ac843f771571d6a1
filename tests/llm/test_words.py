import random
import re

import numpy as np

from vecspark.llm import words as W

TEXTS = ["", None, "a", "One two, THREE four", "É à ß Straße x_y 12áb", "tab\tnew\nline three", "！？", "한국어 텍스트 처리 a b"]


def own_words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def test_word_counts_and_identity():
    w = W.read(TEXTS)
    assert w.counts.tolist() == [len(own_words(t)) for t in TEXTS]
    flat = [x for t in TEXTS for x in own_words(t)]
    seen = {}
    for word, h in zip(flat, w.words.tolist()):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingles_are_sets_of_word_triples():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(12))) for _ in range(60)]
    h, n = W.shingles(W.read(texts), 3)
    at, known = 0, {}
    for t, k in zip(texts, n):
        ws = own_words(t)
        want = set(zip(ws, ws[1:], ws[2:]))
        assert k == len(want)
        for g, v in zip(sorted(want), ()):
            known.setdefault(g, v)
        at += k
    sets = np.split(h, np.cumsum(n)[:-1])
    brute = [set(zip(own_words(t), own_words(t)[1:], own_words(t)[2:])) for t in texts]
    for i in range(0, 60, 7):
        for j in range(60):
            assert len(set(sets[i]) & set(sets[j])) == len(brute[i] & brute[j])


def test_batches_and_blocks_do_not_matter(monkeypatch):
    texts = [f"word{i} and some more text {i % 7}" for i in range(200)]
    whole = W.read(texts)
    monkeypatch.setattr(W, "_BLOCK", 64)
    cut = W.read(texts)
    assert (whole.words == cut.words).all() and (whole.letters == cut.letters).all()
    assert (whole.sequences() == cut.sequences()).all()


def test_letters_ignore_everything_else():
    a, b, c = W.read(["Ab, c-1", "a B\n c 1!", "abc2"]).letters
    assert a == b != c


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    other = base[:300] + [f"x{i}" for i in range(100)]
    h, n = W.shingles(W.read([" ".join(base), " ".join(other)]), 3)
    s = W.signatures(h, n, 400)
    assert abs((s[0] == s[1]).mean() - 298 / 498) < 0.1
    assert W.blocks(s, 3).shape == (2, 133)
