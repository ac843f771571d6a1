import random

import pytest
from test_near import corpus, same, shingle_set

from vecspark.llm import link
from vecspark.sources.store import Conflict

STORE = "document_id string, name string, content string, content_md5 string, source_id string, cls int"
BATCH = "batch_no int, seq_no int, " + STORE


def match(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return same(a, b) or bool(x | y) and len(x & y) / len(x | y) >= 0.6


def brute(store, batch):
    accepted = [(i, t) for i, t in store if t and t.strip()]
    out = set()
    for _, _, i, t in sorted(batch, key=lambda r: r[:2]):
        if not t or not t.strip():
            continue
        hits = [j for j, s in accepted if match(t, s)]
        out |= {tuple(sorted((i, j))) for j in hits}
        if not hits:
            accepted.append((i, t))
    return out


def frames(spark, store, batch):
    s = spark.createDataFrame([(i, None, t, None, "s", 1) for i, t in store], STORE)
    b = spark.createDataFrame([(n, k, i, "n", t, None, None, 1) for n, k, i, t in batch], BATCH)
    return b, s


def test_order_decides_what_is_accepted(spark):
    rng = random.Random(8)
    rows = [t for _, t in corpus(13, 40)]
    rng.shuffle(rows)
    store = [(f"s{i:03d}", t) for i, t in enumerate(rows[: len(rows) // 3])] + [("sn", None), ("sb", "  ")]
    batch = [(i % 4, i, f"b{i:03d}", t) for i, t in enumerate(rows[len(rows) // 3:])]
    base = [f"k{i}" for i in range(30)]
    for i in range(8):  # a chain: each is close to its neighbours only
        batch.append((9, i, f"x{i}", " ".join(base[2 * i:2 * i + 16])))
    batch += [(10, 0, "bn", None), (10, 1, "bb", "　 "), (10, 2, "y1", rows[0].upper()), (11, 0, "y2", rows[0])]
    got = link.found_links(*frames(spark, store, batch)).collect()
    assert {tuple(r) for r in got} == brute(store, batch) and len(got) == len({tuple(r) for r in got})


def test_hot_group_of_copies(spark):
    text = " ".join(f"h{i}" for i in range(30))
    store = [("s", "entirely other text goes here")]
    batch = [(1, i, f"c{i:03d}", text) for i in range(200)]
    got = link.found_links(*frames(spark, store, batch)).collect()
    assert {tuple(r) for r in got} == {("c000", f"c{i:03d}") for i in range(1, 200)}


def test_empty_tables(spark):
    assert link.found_links(*frames(spark, [], [])).count() == 0
    assert link.found_links(*frames(spark, [], [(1, 1, "a", "some words in here")])).count() == 0


def test_representatives_take_the_best_score(spark):
    base = " ".join(f"r{i}" for i in range(40))
    store = [("s1", base + " tail end"), ("s2", base)]
    got = link.representatives(*frames(spark, store, [(1, 1, "b", base.upper())])).collect()
    # a record of the store represents, whatever the ids
    assert [(r["document_id"], r["representative_id"], r["best_id"]) for r in got] == [("b", "s1", "s2")]


def test_without_a_record_of_the_store_the_first_arrival_represents(spark):
    base = " ".join(f"r{i}" for i in range(40))
    batch = [(2, 1, "a", base + " x"), (1, 5, "m", base), (1, 7, "c", base + " y z"), (None, 1, "b", base.upper())]
    got = link.representatives(*frames(spark, [("s", "nothing of the kind here")], batch)).collect()
    assert {(r["document_id"], r["representative_id"]) for r in got} == {("a", "m"), ("c", "m"), ("b", "m")}


def test_calls_of_whole_batches_give_what_one_gives(spark, monkeypatch):
    rng = random.Random(3)
    rows = [t for _, t in corpus(17, 30)]
    rng.shuffle(rows)
    n = len(rows) // 3
    store = [(f"s{i:03d}", t) for i, t in enumerate(rows[:n])]
    batch = [(i // 9 if i % 7 else None, i, f"b{i:03d}", t) for i, t in enumerate(rows[n:])]
    want = brute(store, [(10**6 if r[0] is None else r[0], *r[1:]) for r in batch])
    made = []
    one = link.link
    monkeypatch.setattr(link, "link", lambda *a: made.append(one(*a)) or made[-1])
    for rows_of_a_call, at_least in ((10**6, 1), (15, 3)):
        monkeypatch.setattr(link, "CALL_ROWS", rows_of_a_call)
        made.clear()
        got = [tuple(r) for r in link.found_links(*frames(spark, store, batch)).collect()]
        assert set(got) == want and len(got) == len(want)
        assert len(made) >= at_least and (at_least > 1 or len(made) == 1)


def test_a_small_batch_reads_a_share_of_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(link, "BUCKET", 16)
    rows = corpus(31, 60)
    b, s = frames(spark, rows, [(1, 1, "n", rows[5][1] + " tail"), (1, 2, "o", "three other words")])
    history = link.History.build(s)
    linked = link.link(history, b)
    assert history.buckets >= 128 and 0 < linked.read < 0.5
    assert (rows[5][0], "n") in {(r["accepted_id"], r["in_id"]) for r in linked.pairs.collect()}
    history.append(linked, b)
    again, _ = frames(spark, [], [(2, 1, "p", "three other words!")])
    assert [r["accepted_id"] for r in link.link(history, again).pairs.collect()] == ["o"]


def test_hot_keys_of_history_are_split(spark, monkeypatch):
    monkeypatch.setattr(link.near, "HOT_BLOCK", 3)
    rng = random.Random(6)
    stock = [f"b{i}" for i in range(40)]
    texts = [" ".join(stock + [f"o{rng.randrange(10**6)}" for _ in range(30)]) for _ in range(24)]
    store = [(f"s{i:02d}", t) for i, t in enumerate(texts[:16])]
    batch = [(1, i, f"b{i:02d}", t) for i, t in enumerate(texts[16:] + [t + " end" for t in texts[:6]] + [texts[17] + " x"])]
    got = {tuple(r) for r in link.found_links(*frames(spark, store, batch)).collect()}
    assert got == brute(store, batch) and len(got) == 7


def test_weights_tell_held_out_links_from_rejected_candidates(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    store, batch = [], []
    for g in range(120):
        base = [rng.choice(words) for _ in range(40)]
        store += [(f"s{g:03d}", " ".join(base)), (f"t{g:03d}", " ".join(base[:18] + [rng.choice(words) for _ in range(20)]))]
        batch.append((1, g, f"b{g:03d}", " ".join([*base[:38], rng.choice(words)])))
    b, s = frames(spark, store, batch)
    history = link.History.build(s)
    linked = link.link(history, b)
    records = history.table("document_id", "name", "content", "content_md5", "source_id")
    feats = [link._features(p, b, records).withColumn("part", link.F.xxhash64("in_id") % 2) for p in (linked.pairs, linked.rejected)]
    w = link.fit_weights(*(f.where("part = 0") for f in feats))
    right = [f.where("part <> 0").select((link.score(w) > 0.5).alias("y")).collect() for f in feats]
    assert min(len(r) for r in right) > 10
    assert all(r["y"] for r in right[0]) and not any(r["y"] for r in right[1])


def test_null_numbers_come_last_and_repeated_rows_are_one(spark):
    text = " ".join(f"q{i}" for i in range(20))
    batch = [(None, None, "z", text), (None, None, "y", text), (2, None, "x", text), (2, 1, "w", text), (2, 1, "w", text)]
    got = link.found_links(*frames(spark, [], batch)).distinct().collect()
    assert {tuple(r) for r in got} == {("w", "x"), ("w", "y"), ("w", "z")}


def test_history_is_taken_up_by_later_batches(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [t for _, t in corpus(21, 30)]
    rng.shuffle(rows)
    n = len(rows) // 4
    store = [(f"s{i:03d}", t) for i, t in enumerate(rows[:n])]
    batch = [(1 + i * 3 // len(rows[n:]), i, f"b{i:03d}", t) for i, t in enumerate(rows[n:])]
    base = [f"k{i}" for i in range(30)]
    copied = " ".join(f"w{i}" for i in range(20))
    batch += [(1, 900, "x1", " ".join(base[:16])), (1, 901, "x3", " ".join(base[8:24])), (2, 900, "x2", " ".join(base[4:20]))]
    # the accepted copy comes after another one in the file
    batch += [(1, 911, "z1", copied), (1, 910, "z0", copied), (3, 910, "z2", copied.upper())]
    at = str(tmp_path / "history")
    b, s = frames(spark, store, batch)
    link.History.build(s, at)
    profile, profiled = link.near.profile, []
    monkeypatch.setattr(link.near, "profile", lambda df, *a, **k: profiled.append(df.count()) or profile(df, *a, **k))
    got, written = [], []
    for k in (1, 2, 3):
        history = link.History.open(s, at)
        part = b.where(f"batch_no = {k}")
        got += [tuple(r) for r in link.found_links(part, s, history=history).collect()]
        nodes = history._read("representatives").where(f"version = {k + 1}").select(link._id_of("node").alias("id"))
        written.append({r["id"] for r in nodes.collect()})
    assert set(got) == brute(store, batch) and len(got) == len(set(got))
    assert sum(profiled) == len(batch)
    name = {x: x for p in got for x in p}
    first = {i: (n, k) for n, k, i, _ in batch}  # records of the store come before arrivals, ids decide among them
    linked_as_later = {max(p, key=lambda x: first.get(x, (-1, 0))) for p in got}

    def order(x):
        return (x in linked_as_later, first.get(x, (-1, 0)), x)

    for _ in name:
        for p in got:
            name[p[0]] = name[p[1]] = min(name[p[0]], name[p[1]], key=order)
    assert {r["id"]: r["representative_id"] for r in link.History.open(s, at).representatives().collect()} == name
    # only touched clusters are written again
    new = {x for p in got for x in p if any(y[0] == "b" or y[0] in "xz" for y in p)}
    assert written[2] and written[2] < new and not {"x1", "x2"} & written[2]
    with pytest.raises(ValueError):
        link.History.build(s, at)
    linked = link.link(history, b.where("batch_no = 3"))
    history.append(linked, b.where("batch_no = 3"))
    with pytest.raises(Conflict):
        history.append(linked, b.where("batch_no = 3"))


def test_near_edits_only_have_the_most_similar_as_best(spark):
    store, batch = [], []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(40)]
        store += [(f"s{g:02d}a", " ".join([*words[:34], "o", "t", "h", "e", "r"])), (f"s{g:02d}b", " ".join([*words, "end"]))]
        store.append((f"s{g:02d}c", " ".join([*words[:14], *(f"g{g}x{i}" for i in range(14))])))  # a candidate, no link
        batch.append((1, g, f"b{g:02d}", " ".join([*words, "new", "tail"])))
    b, s = frames(spark, store, batch)
    linked = link.link(link.History.build(s), b)
    assert linked.pairs.where("same_form").count() == 0
    rejected = linked.rejected.collect()
    assert rejected and all(r["similarity"] < 0.6 for r in rejected)
    got = link.representatives(b, s).collect()
    assert {(r["document_id"], r["best_id"]) for r in got} == {(f"b{g:02d}", f"s{g:02d}b") for g in range(12)}


def test_repeated_rows_give_their_pairs_once(spark):
    text = " ".join(f"q{i}" for i in range(20))
    near_text = text + " end"
    store = [("s", text), ("s", text), ("t", near_text)]
    batch = [(2, 1, "w", near_text), (2, 1, "w", near_text), (2, 2, "x", "other " * 3 + "words"), (2, 3, "y", "other other other words")]
    got = [tuple(r) for r in link.found_links(*frames(spark, store, batch * 2)).collect()]
    assert sorted(got) == [("s", "w"), ("t", "w"), ("x", "y")]
    rows = spark.createDataFrame([("a", text), ("a", text), ("b", near_text), ("b", near_text)], "document_id string, content string")
    assert [tuple(r) for r in link.near.found_pairs(rows).collect()] == [("a", "b")]
