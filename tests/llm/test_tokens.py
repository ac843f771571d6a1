import random

import pytest

from vecspark.llm import budget, packing, tokens

pytest.importorskip("public_tokenizers")

NASTY = [
    "", " ", "a", "it's they'll WE'RE 'tis", "tabs\t\tand  spaces   \n\n end ", "<|endoftext|> is text", "123456789012 ½ ² Ⅷ",
    "ünïcode — “quotes” … 한국어 \U0001f600\U0001f600 á", "　 x  y", "!!!???'''", "\x1c\x1d x",
]


@pytest.fixture(scope="module")
def v():
    return tokens.bpe(tokens.default_vocabulary())


def longs():
    rng = random.Random(4)
    yield "a" * 5000
    yield " " * 3000 + "x" + "\n" * 2500
    yield "".join(rng.choice("abcde") for _ in range(6000))
    yield "".join(rng.choice("一二三四五六七八九十") for _ in range(3000))
    yield "".join(rng.choice("ab'sre ") for _ in range(6000))
    yield "".join(rng.choice("!?.-'") for _ in range(4000))
    yield "".join(rng.choice("0123456789") for _ in range(4000))
    yield " ".join(rng.choice(["the", "it's", "12", "ünder", "x'll"]) for _ in range(3000))
    yield "".join(rng.choice("a1'! \né一") for _ in range(8000))
    yield "\r\n".join("line of text" for _ in range(900))


def test_tree_equals_whole(v):
    for t in longs():
        for size in (64, 300, 1000):
            assert tokens.encode_tree(v, t, size) == v.encoding.encode_ordinary(t)


def test_encode_frame(spark, v):
    texts = [*NASTY, *longs(), None]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(3, NASTY[3], 1, "x"), (11, texts[11], 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, row string")
    got = tokens.encode(df, "doc_id", "text", segment=500).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == v.encoding.encode_ordinary(texts[r["id"]] or "")
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def test_same_ids_as_the_other_library(v):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in [*NASTY, *longs()]:
        assert v.encoding.encode_ordinary(text) == t.encode(text, add_special_tokens=False).ids


def test_walk_is_exact_on_sorted_pieces(v):
    rng = random.Random(2)
    pieces = {"".join(rng.choice("abcdeo thn") for _ in range(rng.randrange(1, 14))) for _ in range(3000)}
    pieces |= {p for t in [*NASTY, *longs()] for p in v.pattern.findall(t) if len(p) < 400}
    walk = budget.Walk(v)
    for p in sorted(pieces):
        assert walk.tokens(p.encode()) == len(v.piece(p.encode())), p


@pytest.mark.parametrize("limit", [0, 10**6])
def test_budget(spark, v, monkeypatch, limit):
    monkeypatch.setattr(budget, "OFTEN", limit)
    texts = [*NASTY, *[t[:700] for t in longs()], None, "the the the"]
    meta = ['{"lang": "EN-us", "domain": " Health "}', '{"lang": "", "x": 1}', "broken{", None, '{"lang": "deutsch"}']
    rows = [(f"d{i}", t, ["s1", "s2", None][i % 3], meta[i % 5], 0, "x") for i, t in enumerate(texts)]
    store = spark.createDataFrame(rows, "document_id string, content string, source_id string, metadata string, total_tokens int, tokens string")
    sources = spark.createDataFrame([("s1", "T", "energy", "fr"), ("s2", "T", None, "en")], "source_id string, title string, source_domain string, default_lang string")
    got = budget.token_budget(store, sources).collect()
    want = {}
    for _, t, s, m, *_ in rows:
        lang, domain = {"s1": ("fr", "energy"), "s2": ("en", None), None: (None, None)}[s]
        if m == meta[0]:
            lang, domain = "en", "health"
        if m == meta[4]:
            lang = "de"
        n = len(v.encoding.encode_ordinary(t or ""))
        a = want.setdefault((s, lang, domain), [0, 0])
        a[0] += 1
        a[1] += n
    assert {(r["source_id"], r["language"], r["domain"]): [r["documents"], r["tokens"]] for r in got} == want
    assert budget.token_budget(store.limit(0), sources.limit(0)).count() == 0


def best_fit_decreasing(sizes, capacity=2048):
    """Containers that the usual offline rule needs."""
    full = sum(s // capacity for s in sizes if s)
    gaps = []
    for s in sorted((s % capacity for s in sizes if s and s % capacity), reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return full + len(gaps)


def test_packing(spark):
    rng = random.Random(6)
    sizes = [rng.choice([0, 1, 7, 50, 300, 700, 1000, 2048, 5000, 4096]) for _ in range(3000)] + [None]
    items = spark.createDataFrame([(i, s, 1) for i, s in enumerate(sizes)], "doc_id long, n int, size int")
    got = packing.pack(items, "doc_id", "n").collect()
    by_id, load = {}, {}
    for r in got:
        by_id.setdefault(r["id"], []).append((r["part_no"], r["start"], r["size"]))
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["size"]
    assert max(load.values()) <= 2048
    for i, s in enumerate(sizes):
        parts = sorted(by_id.get(i, []))
        assert sum(p[2] for p in parts) == (s or 0)
        assert [p[1] for p in parts] == [2048 * k for k in range(len(parts))]
        assert len(parts) == (-(-s // 2048) if s else 0)
    assert len(load) <= 1.03 * best_fit_decreasing(sizes) + 2
    assert packing.pack(items.limit(0), "doc_id", "n").count() == 0
    again = packing.pack(items.repartition(7), "doc_id", "n").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_open_containers_of_many_shards_are_packed_again(spark, monkeypatch):
    items = spark.createDataFrame([(i, 37 + (i * 7919) % 700) for i in range(4000)] + [(9000, 5000)], "id long, n int")
    counts = []
    for size in (10**6, 500):
        monkeypatch.setattr(packing, "SHARD_ITEMS", size)
        got = packing.pack(items, "id", "n", 2048).collect()
        assert len(got) == 4003 and len({(r["id"], r["part_no"]) for r in got}) == 4003
        used = {}
        for r in got:
            used[r["container_id"]] = used.get(r["container_id"], 0) + r["size"]
        assert max(used.values()) <= 2048
        counts.append(len(used))
    assert counts[1] <= counts[0] * 1.02
