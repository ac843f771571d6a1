import random
import re

import pytest

from vecspark.llm import components, near

SCHEMA = "document_id string, content string, key long, cls string, id int"


def shingle_set(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return set(zip(w, w[1:], w[2:]))


def form(t):
    lines = [x for x in t.lower().splitlines() if x.strip()]
    letters = re.sub(r"[\W_]+", "", t.lower())
    card = bool(lines) and all(re.match(r"\s*[^\W_]+\s*:.*[^\W_]", x) for x in lines)
    return letters, tuple(sorted(re.sub(r"[\W_]+", "", x) for x in lines)) if card else None


def same(a, b):
    (p, c), (q, d) = form(a), form(b)
    return c == d if c and d else p == q


def brute(rows, threshold):
    out = set()
    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            if s is None or t is None:
                continue
            x, y = shingle_set(s), shingle_set(t)
            if x | y and len(x & y) / len(x | y) >= threshold and not same(s, t):
                out.add(tuple(sorted((a, b))))
    return out


def corpus(seed=5, n=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 60))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            edit = list(base)
            for _ in range(rng.randrange(1, 4)):
                k = rng.randrange(len(edit))
                edit[k:k + rng.randrange(2)] = [rng.choice(words)]
            if rng.random() < 0.3:
                edit = edit[len(edit) // 2:] + edit[: len(edit) // 2]
            texts.append(" ".join(edit))
    texts += ["Name: x\nCity: long words here now\nNote: one two three four five", "City: long words here now\nname: X\nNOTE: one two three, four five"]
    return [(f"d{i:03d}", t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(a, t, 1, "x", 2) for a, t in rows], SCHEMA)


def test_pairs_equal_brute_force(spark):
    rows = corpus() + [("n1", None), ("e1", ""), ("s1", "two words"), ("s2", "two words")]
    got = {tuple(r) for r in near.found_pairs(frame(spark, rows), threshold=0.6).collect()}
    assert got == brute(rows, 0.6)


def test_copies_cost_no_pairs_and_all_expand(spark):
    text = " ".join(f"u{i}" for i in range(40))
    rows = [(f"c{i:03d}", text) for i in range(300)] + [("z", text + " more")]
    got = near.found_pairs(frame(spark, rows), threshold=0.6).collect()
    assert {tuple(r) for r in got} == {(f"c{i:03d}", "z") for i in range(300)}


def test_very_long_text(spark):
    text = " ".join(f"u{i % 9973}x{i % 7919}" for i in range(150_000))
    rows = [("a", text), ("b", text + " tail"), ("c", "short text of words")]
    assert [tuple(r) for r in near.found_pairs(frame(spark, rows), threshold=0.6).collect()] == [("a", "b")]


def test_empty_table(spark):
    assert near.found_pairs(frame(spark, [])).count() == 0
    assert near.near_groups(frame(spark, [])).count() == 0


def test_groups_and_links(spark):
    base = [f"v{i}" for i in range(60)]
    rows = [("a", " ".join(base)), ("b", " ".join(base[:-1])), ("c", " ".join(base + ["x"])), ("d", "something else entirely here")]
    got = {r["id"]: (r["group_id"], r["n_links"]) for r in near.near_groups(frame(spark, rows), threshold=0.8).collect()}
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("a", 2)}


def test_hot_blocks_are_split_and_lose_nothing(spark, monkeypatch):
    rng = random.Random(2)
    stock = [f"b{i}" for i in range(40)]  # half of every text
    rows = []
    for i in range(30):
        own = [f"o{rng.randrange(10**6)}" for _ in range(36)]
        rows += [(f"h{i:02d}a", " ".join(stock + own)), (f"h{i:02d}b", " ".join(stock + own[:30]))]
    rows += corpus(9, 20)
    want = brute(rows, 0.6)
    split, monkeypatched = near._split, []
    monkeypatch.setattr(near, "HOT_BLOCK", 4)
    monkeypatch.setattr(near, "_split", lambda *a: monkeypatched.append(split(*a)) or monkeypatched[-1])
    got = [tuple(r) for r in near.found_pairs(frame(spark, rows), threshold=0.6).collect()]
    assert set(got) == want and len(got) == len(want)
    # all pairs within the stock's blocks would be 60 * 59 / 2
    assert 30 <= monkeypatched[0].count() < 200


def test_the_hamming_distance_decides():
    assert near.radius(0.6) < 50 and near.radius(0.8) < 32


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (5, 4), (3, 1)], [(i, i + 1) for i in range(40)]])
def test_components(spark, edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for x in parent}
    got = components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want
