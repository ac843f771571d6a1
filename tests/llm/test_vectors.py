import numpy as np
import pytest

from vecspark.llm import clusters, knn

SCHEMA = "point_id string, document_id string, embedding array<float>, cls int, vec string"


def rows_of(x, prefix="p"):
    return [(f"{prefix}{i:05d}", f"doc{i}", [float(v) for v in r], 1, "v") for i, r in enumerate(x)]


BAD = [
    ("z1", "d", None, 1, "v"), ("z2", "d", [1.0] * 32, 1, "v"), ("z3", "d", [0.0] * 64, 1, "v"),
    ("z4", "d", [float("nan")] + [1.0] * 63, 1, "v"), ("z5", "d", [None] + [1.0] * 63, 1, "v"), ("z6", "d", [], 1, "v"),
]


def planted(seed=1, k=6, each=60, noise=30):
    rng = np.random.RandomState(seed)
    c = rng.normal(size=(k, 64))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = np.concatenate([c[i] + rng.normal(size=(each, 64)) * 0.1 for i in range(k)] + [rng.normal(size=(noise, 64))])
    return x * rng.uniform(0.2, 5, (len(x), 1)), np.repeat(np.arange(k), each)


def test_clusters(spark):
    x, label = planted()
    rows = rows_of(x) + BAD
    df = spark.createDataFrame(rows + rows[:40], SCHEMA)
    got = clusters.found_clusters(df).collect()
    assert len(got) == len(label) - 6
    first = {f"p{i * 60:05d}": i for i in range(6)}
    for r in got:
        assert label[int(r["point_id"][1:])] == first[r["cluster_point_id"]]
    typical = clusters.described(df, 3).collect()
    assert len(typical) == 18 and {r["size"] for r in typical} == {60}


def test_no_clusters(spark):
    assert clusters.found_clusters(spark.createDataFrame([], SCHEMA)).count() == 0
    assert clusters.found_clusters(spark.createDataFrame(BAD, SCHEMA)).count() == 0
    assert clusters.found_clusters(spark.createDataFrame(rows_of(np.eye(64)), SCHEMA)).count() == 0


def brute(x, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


def around(rng, centre, n, cosine=0.75):
    """Unit vectors at about this cosine from a centre."""
    noise = rng.normal(size=(n, 64))
    noise -= (noise @ centre)[:, None] * centre
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return cosine * centre + (1 - cosine**2) ** 0.5 * noise


@pytest.mark.parametrize("lost", [0, 2])
def test_close_directions_small_clusters_and_lost_seeds(spark, monkeypatch, lost):
    rng = np.random.RandomState(8)
    a, b, c = np.linalg.qr(rng.normal(size=(64, 3)))[0].T
    b = 0.45 * a + (1 - 0.45**2) ** 0.5 * b  # two directions at a cosine of 0.45
    # rows of one direction that are near the other belong to none
    x = np.concatenate([around(rng, a, 900, 0.68), around(rng, b, 800, 0.68), around(rng, c, 20), rng.normal(size=(900, 64))])
    condense, calls = clusters._condense, []

    def forgetful(*args):
        calls.append(1)
        tops, mass = condense(*args)
        return (tops[lost:], mass[lost:]) if len(calls) == 1 else (tops, mass)

    monkeypatch.setattr(clusters, "_condense", forgetful)
    got = clusters.cluster(spark.createDataFrame(rows_of(x), SCHEMA), "point_id", [], "embedding")
    sizes = sorted(r["size"] for r in got.select("cluster_id", "size").distinct().collect())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ np.stack([a, b, c]).T
    top2 = np.sort(cos, 1)
    want = np.bincount(cos.argmax(1)[(top2[:, 2] >= 0.6) & (top2[:, 1] < 0.5)], minlength=3)
    assert len(sizes) == 3 and np.abs(np.array(sizes) - np.sort(want)).max() <= 12


def test_scan_abandons_and_still_finds():
    x, _ = planted(3, 8, 700, 400)
    x = np.concatenate([x, x[:300] + np.random.RandomState(0).normal(size=(300, 64)) * 0.02 * np.linalg.norm(x[:300], axis=1, keepdims=True)])
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    lists = knn.Lists(knn.spherical_kmeans(u[:1000], 8), np.zeros(8, np.int64))
    lists.held, lists.need = np.full(8, 700), 3000
    home, probes = lists.probed(u, np.arange(8))
    every = np.ones(len(u), bool)
    rows, best, score, done, whole = knn.scan_lists(u @ knn.rotation(64), home, every, every, probes, 5)
    want, s = brute(u.astype(float))
    assert (rows == np.arange(len(u))).all() and not (best == rows[:, None]).any()
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(best, want)]) > 0.95
    assert np.allclose(score, np.take_along_axis(s, best, 1), atol=1e-5)
    assert done < 0.5 * whole
    # pairs of SURE and above are kept whatever the bound
    close = [(i, j) for i in range(len(u)) for j in want[i] if s[i, j] >= 0.95]
    assert len(close) >= 600 and all(j in best[i] for i, j in close)


@pytest.mark.parametrize("tile", [16_384, 64])
def test_neighbours_and_copies(spark, monkeypatch, tile):
    monkeypatch.setattr(knn, "TILE", tile)
    monkeypatch.setattr(knn, "ASKING", tile)
    monkeypatch.setattr(knn, "LIST", 128)
    x, _ = planted(7, 5, 50, 20)
    x = np.concatenate([x, x[:8] + np.random.RandomState(0).normal(size=(8, 64)) * 0.01, np.repeat(x[100:101], 9, 0), x[200:202]])
    df = spark.createDataFrame(rows_of(x) + BAD + rows_of(x)[:20], SCHEMA)
    got = knn.neighbours(df).collect()
    mine = {}
    for r in got:
        mine.setdefault(r["id"], {})[r["rank_no"]] = (r["other_id"], r["cosine"])
    want, s = brute(x.astype(np.float32).astype(float))
    assert all(sorted(v) == [1, 2, 3, 4, 5] for v in mine.values()) and len(mine) == len(x)
    hit = 0
    for i in range(len(x)):
        floor = np.sort(s[i])[-5]
        hit += sum(s[i, int(o[1:])] >= floor - 1e-5 for o, _ in mine[f"p{i:05d}"].values())
    assert hit / (5 * len(x)) > 0.95
    # a group of ten equal vectors: the smallest other ids come first
    tens = ["p00100", *(f"p{i:05d}" for i in range(278, 287))]
    assert [mine["p00286"][k][0] for k in range(1, 6)] == tens[:5]
    assert [mine["p00100"][k][0] for k in range(1, 6)] == tens[1:6]
    pairs = {tuple(r) for r in knn.found_pairs(df).collect()}
    near = {tuple(sorted((f"p{i:05d}", o))) for i in range(len(x)) for o, c in mine[f"p{i:05d}"].values() if c >= 0.95}
    assert pairs == near


def test_many_more_lists_than_a_query_may_skip(spark, monkeypatch):
    monkeypatch.setattr(knn, "LIST", 16)  # 75 lists in two clusters
    rng = np.random.RandomState(4)
    c = rng.normal(size=(2, 64)) / 8
    x = np.concatenate([c[i] + rng.normal(size=(550, 64)) * 0.1 for i in range(2)])
    x = np.concatenate([x, x[:100] + rng.normal(size=(100, 64)) * 0.03])
    got = {}
    df = spark.createDataFrame(rows_of(x), SCHEMA)
    for r in knn.neighbours(df).collect():
        got.setdefault(int(r["id"][1:]), set()).add(int(r["other_id"][1:]))
    want, s = brute(x.astype(np.float32).astype(float))
    assert np.mean([len(got[i] & set(want[i])) / 5 for i in range(len(x))]) > 0.95
    close = {tuple(sorted((f"p{i:05d}", f"p{j:05d}"))) for i in range(len(x)) for j in want[i] if s[i, j] >= 0.95}
    assert len(close) > 50 and {tuple(r) for r in knn.found_pairs(df).collect()} == close


def crowded(seed=5):
    """Clusters, rows around none of them, close pairs of both kinds, and a crowd of close rows."""
    rng = np.random.RandomState(seed)
    c = rng.normal(size=(6, 64))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = np.concatenate([around(rng, v, 250) for v in c] + [rng.normal(size=(250, 64)) / 8, around(rng, c[0], 150, 0.99)])
    return np.concatenate([x, x[::7] + rng.normal(size=(len(x[::7]), 64)) * rng.uniform(0, 0.04, (len(x[::7]), 1))])


@pytest.mark.parametrize("part", [131_072, 90])
def test_found_pairs_of_groups_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(knn, "PART", part)
    monkeypatch.setattr(knn, "LIST", 64)
    x = crowded()
    want, s = brute(x.astype(np.float32).astype(float))
    close = {tuple(sorted((f"p{i:05d}", f"p{j:05d}"))) for i in range(len(x)) for j in want[i] if s[i, j] >= 0.95}
    df = spark.createDataFrame(rows_of(x) + BAD, SCHEMA)
    got = [tuple(r) for r in knn.found_pairs(df).collect()]
    assert len(close) > 500 and len(got) == len(close) and set(got) == close


def test_found_pairs_compares_each_pair_once_and_few(spark):
    x = crowded()
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    lists = knn.Lists(knn.spherical_kmeans(u, 24))
    reach = knn.Reach(lists, 0.95)
    home, rows, grp = reach.met(u)
    best, tested = np.full((len(u), 5), -2.0), 0
    for g in np.unique(grp):
        at = rows[grp == g]
        inside = reach.group[home[at]] == g
        if inside.any():
            part = knn.Part(reach, u[at[inside]], home[at[inside]], at[inside], 5)
            asking = at[~inside]
            _, score = part.ask(u[asking], home[asking], asking, np.zeros(len(asking), bool))
            for i, new in ((at[inside], part.score), (asking, score)):
                best[i] = -np.sort(-np.concatenate([best[i], new], 1), 1)[:, :5]
            tested += part.tested
    want, s = brute(u.astype(float))
    want = np.take_along_axis(s, want, 1)
    assert np.allclose(np.where(best >= 0.95, best, 0), np.where(want >= 0.95, want, 0), atol=1e-5)
    # the search of neighbours of any cosine, which found_pairs used to be
    probed, probes = lists.probed(u, np.arange(24))
    every = np.ones(len(u), bool)
    *_, done, whole = knn.scan_lists(u, probed, every, every, probes, 5)
    assert tested < 0.15 * len(u) ** 2 and tested * 26 < 0.3 * done


def test_found_pairs_of_few_points(spark):
    assert knn.found_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert knn.found_pairs(spark.createDataFrame(rows_of(np.eye(64)[:3]), SCHEMA)).count() == 0


def test_few_points(spark):
    assert knn.neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert knn.neighbours(spark.createDataFrame(rows_of(np.eye(64)[:1]), SCHEMA)).count() == 0
    assert knn.neighbours(spark.createDataFrame(rows_of(np.eye(64)[:3]), SCHEMA)).count() == 6


def test_texts_by_hashed_features(spark):
    rng = np.random.RandomState(2)
    topics = [[f"t{t}w{i}" for i in range(12)] for t in range(3)]
    rows = [(f"p{t}{i:03d}", " ".join(rng.choice(topics[t], 30)) + f" the own{t}{i}") for t in range(3) for i in range(40)]
    df = spark.createDataFrame([*rows, ("n", None), ("e", "")], "point_id string, content string")
    vec = clusters.hashed_vectors(df, "point_id", "content", 64)
    assert vec.count() == 121
    got = clusters.cluster(vec.withColumnRenamed("id", "point_id"), "point_id", [], "embedding", near=0.5, far=0.45).collect()
    assert len(got) == 120 and {(r["point_id"][:2], r["cluster_id"]) for r in got} == {(f"p{t}", f"p{t}000") for t in range(3)}
    assert clusters.hashed_vectors(df.limit(0), "point_id", "content").count() == 0
